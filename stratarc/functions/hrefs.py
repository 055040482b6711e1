"""The href of a URL (C6) as the URL standard parses and serialises it, in Column expressions.

A URL that is its own href passes one pattern and nothing else; the rest goes through the steps below, inside the JVM.
Hosts are lower-case, percent-decoded, ASCII by Punycode; numbers as hosts are IPv4 addresses, brackets hold IPv6.
Not done, since Spark has no Unicode normalisation: decomposed accents and compatibility letters of hosts other than
full-width ASCII stay as they are; Punycode in the input is not decoded to check it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default ports (fixed values); schemes with one have an origin.
PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
SPECIAL = (*PORTS, "file")

# What each part percent-encodes (fixed values of the URL standard, as character classes).
CONTROLS = r"\x00-\x1f\x7f-\x{10ffff}"
FRAGMENT = CONTROLS + ' "<>`'
QUERY = CONTROLS + ' "#<>'
PATH = QUERY + r"?\^`{}"
USER = PATH + r"/:;=@\[\\\]|"
# Characters that no host may have; a domain may have no controls and no percent sign either.
NO_HOST = r"\x00\t\n\r #/:<>?@\[\\\]\^|"
NO_DOMAIN = NO_HOST + r"\x01-\x1f%\x7f\x{fffd}"

DOT = r"(?:\.|%2[eE])"
#: Its own href: web scheme, plain domain that ends in a letter, no port, nothing to encode, no dot segments.
PLAIN = rf"^(?:https?|wss?|ftp)://(?:[a-z0-9_-]+\.)*[a-z](?:[a-z0-9-]*[a-z0-9])?(?:/(?!{DOT}{{1,2}}(?:[/?#]|\z))[A-Za-z0-9._~!$&'()*+,;=:@%|\[\]-]*)+(?:\?[!$-&(-;=?-~]*)?(?:#[!#-;=?-_a-~]*)?\z"

#: Full-width forms of ASCII and the other full stops of domains; characters that a domain drops.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3002\uff61"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + ".."
DROPPED = r"[\x{ad}\x{200b}\x{2060}\x{feff}\x{fe00}-\x{fe0f}]"


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def stripped(url: Column) -> Column:
    """Without controls and blanks around it, and without tabs and line breaks."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+\z|[\t\n\r]", "")


def _encoded(s: Column, chars: str) -> Column:
    def coded(s: Column) -> Column:
        runs = F.regexp_extract_all(s, F.lit(f"(?s)[{chars}]+|[^{chars}]+"), F.lit(0))
        escaped = F.transform(runs, lambda r: F.when(r.rlike(f"^[{chars}]"), F.regexp_replace(F.hex(r), "(..)", "%$1")).otherwise(r))
        return F.when(s.rlike(f"[{chars}]"), F.array_join(escaped, "")).otherwise(s)

    return let(s, coded)


def _undotted(path: Column) -> Column:
    """Dot segments, plain or escaped, removed; a trailing one leaves a slash."""
    one, two = f"^{DOT}$", f"^{DOT}{{2}}$"

    def walked(steps: Column) -> Column:
        step = lambda out, s: F.when(s.rlike(two), F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when(s.rlike(one), out).otherwise(F.concat(out, F.array(s)))
        tail = F.when(F.element_at(steps, -1).rlike(f"^{DOT}{{1,2}}$"), "/").otherwise("")
        return F.aggregate(steps, F.array().cast("array<string>"), step, lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when(F.size(k) > 0, tail).otherwise("")))

    return let(path, lambda p: F.when(p.rlike(f"/{DOT}{{1,2}}(/|$)"), let(F.split(F.substring(p, F.lit(2), F.length(p)), "/"), walked)).otherwise(p))


# --- hosts

def _long(x) -> Column:
    return F.lit(x).cast("long")


def _digits(delta: Column, bias: Column) -> Column:
    """A delta as a generalised variable-length integer of Punycode."""

    def step(state: Column, k: Column) -> Column:
        t = F.greatest(_long(1), F.least(_long(26), k - bias))
        more = state.q >= t
        digit = F.when(more, t + (state.q - t) % (36 - t)).otherwise(state.q)
        shown = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz0123456789"), (digit + 1).cast("int"), F.lit(1))
        after = F.struct(F.concat(state.out, shown).alias("out"), F.when(more, F.floor((state.q - t) / (36 - t))).otherwise(_long(-1)).alias("q"))
        return F.when(state.q < 0, state).otherwise(after)

    places = F.sequence(_long(36), _long(36 * 12), _long(36))
    return F.aggregate(places, F.struct(F.lit("").alias("out"), delta.alias("q")), step, lambda s: s.out)


def _adapted(delta: Column, size: Column, first: Column) -> Column:
    start = F.floor(delta / F.when(first, 700).otherwise(2))
    step = lambda s, _: F.when(s.d > 455, F.struct(F.floor(s.d / 35).alias("d"), (s.k + 36).alias("k"))).otherwise(s)
    return let(start, lambda d: F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.struct((d + F.floor(d / size)).alias("d"), _long(0).alias("k")), step, lambda s: s.k + F.floor(s.d * 36 / (s.d + 38))))


def _punycode(label: Column) -> Column:
    """RFC 3492: letters above ASCII in the order in which a decoder inserts them, each as a delta from the last."""

    def coded(points: Column) -> Column:
        plain = F.filter(points, lambda p: p < 128)
        marked = F.transform(points, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
        before = lambda e: F.size(F.filter(marked, lambda m: (m.i < e.i) & (m.p <= e.p)))
        events = F.array_sort(F.filter(F.transform(marked, lambda e: F.struct(e.p.alias("p"), e.i.alias("i"), before(e).alias("at"))), lambda e: e.p >= 128))

        def deltas(events: Column) -> Column:
            size = lambda k: (F.size(plain) + k + 1).cast("long")
            last = lambda k: F.get(events, k - 1)
            delta = lambda e, k: (e.p - F.coalesce(last(k).p, F.lit(128))) * size(k) + e.at - F.coalesce(last(k).at + 1, F.lit(0))
            return F.transform(events, lambda e, k: F.struct(delta(e, k).cast("long").alias("delta"), size(k).alias("size"), (k == 0).alias("first")))

        step = lambda s, d: F.struct(F.concat(s.out, _digits(d.delta, s.bias)).alias("out"), _adapted(d.delta, d.size, d["first"]).alias("bias"))
        tail = F.aggregate(let(events, deltas), F.struct(F.lit("").alias("out"), _long(72).alias("bias")), step, lambda s: s.out)
        head = F.regexp_replace(label, r"[^\x00-\x7f]", "")
        return F.concat(F.lit("xn--"), head, F.when(head != "", "-").otherwise(""), tail)

    return F.when(label.rlike(r"[^\x00-\x7f]"), let(F.transform(F.split(label, ""), lambda c: F.ascii(c)), coded)).otherwise(label)


def _number(part: Column) -> Column:
    """A part of an IPv4 address: decimal, octal behind 0, hexadecimal behind 0x; -1 where it is none of them."""
    digits = F.regexp_replace(part, "^0[xX]?0*", "")
    base = lambda b: F.when(digits == "", _long(0)).otherwise(F.conv(digits, b, 10).cast("long"))
    return (
        F.when(F.length(digits) > 11, _long(-1))
        .when(part.rlike("^0[xX][0-9a-fA-F]*$"), base(16))
        .when(part.rlike("^0[0-7]*$"), base(8))
        .when(part.rlike("^[1-9][0-9]*$"), base(10))
        .otherwise(_long(-1))
    )


def _ipv4(host: Column) -> Column:
    """Four decimal bytes from one to four numbers, of which the last fills what is left; null where they do not fit."""

    def shown(n: Column) -> Column:
        heads = F.slice(n, F.lit(1), F.size(n) - 1)
        fits = (F.size(n) <= 4) & F.forall(n, lambda x: x >= 0) & F.forall(heads, lambda x: x < 256) & (F.element_at(n, -1) < F.pow(F.lit(256), 5 - F.size(n)))
        rest = F.transform(F.sequence(F.size(n), F.lit(4)), lambda i: F.floor(F.element_at(n, -1) / F.pow(F.lit(256), 4 - i)).cast("long") % 256)
        return F.when(fits, F.array_join(F.transform(F.concat(heads, rest), lambda x: x.cast("string")), "."))

    return let(F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), _number), shown)


def _ipv6(text: Column) -> Column:
    """Eight pieces without leading zeros, the first longest run of zeros as '::'; null where it is no address."""
    tail = r"^(.*:)(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
    byte = lambda i: F.regexp_extract(text, tail, i)
    two = lambda i: F.hex(byte(i).cast("long") * 256 + byte(i + 1).cast("long"))
    small = F.forall(F.array(*(byte(i) for i in range(2, 6))), lambda b: b.rlike("^(0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    whole = F.lower(F.when(~text.rlike(tail), text).when(small, F.concat(byte(1), two(2), F.lit(":"), two(4))))

    def shown(text: Column) -> Column:
        gap = F.instr(text, "::")
        halves = F.split(text, "::")
        pieces = lambda half: F.filter(F.split(half, ":"), lambda p: p != "")
        left, right = pieces(F.get(halves, F.lit(0))), F.coalesce(pieces(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
        size = F.size(left) + F.size(right)
        right_form = text.rlike("^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?(::([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?)?$") & F.when(gap > 0, size <= 7).otherwise(size == 8)
        every = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - size, F.lit(0))), right)
        row = F.array_join(F.transform(every, lambda p: F.regexp_replace(p, "^0+(?=.)", "")), ":")
        runs = lambda row: F.coalesce(*(F.when(row.rlike(z), F.regexp_replace(row, z, "$1::$2")) for z in (f"^(.*?)(?:^|:)0(?::0){{{k - 1}}}(?::|$)(.*)$" for k in range(8, 1, -1))), row)
        return F.when(right_form, F.concat(F.lit("["), let(row, runs), F.lit("]")))

    return let(whole, shown)


def _domain(host: Column) -> Column:
    """A host of a special scheme; null where it is none."""
    plus = F.regexp_replace(F.regexp_replace(host, r"\+", "%2B"), "%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.when(host.contains("%"), F.try_url_decode(plus)).otherwise(host)
    mapped = F.lower(F.translate(F.regexp_replace(decoded, DROPPED, ""), WIDE, NARROW))
    ascii_ = lambda d: F.when(d.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(F.split(d, r"\."), _punycode), ".")).otherwise(d)
    named = lambda d: F.when(d.rlike(r"(^|\.)([0-9]+|0x[0-9a-f]*)\.?$"), _ipv4(d)).when(d != "", d)
    return let(let(mapped, lambda m: F.when(~m.rlike(f"[{NO_DOMAIN}]"), ascii_(m))), named)


def _host(host: Column, special: Column) -> Column:
    opaque = F.when(~host.rlike(f"[{NO_HOST}]"), _encoded(host, CONTROLS))
    return F.when(host.startswith("["), F.when(host.endswith("]"), _ipv6(F.regexp_replace(host, r"^\[|\]$", "")))).when(special, _domain(host)).otherwise(opaque)


# --- whole URLs

#: scheme, body, ?query, #fragment; user, host, port of an authority
WHOLE = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*):([^?#]*)(\?[^#]*)?(#.*)?\z"
PLACE = r"(?s)^(?:(.*)@)?(\[[^\]]*\]|[^:@]*)(?::([^:@]*))?\z"


def _login(text: Column) -> Column:
    user, password = F.regexp_extract(text, "(?s)^([^:]*)", 1), F.regexp_extract(text, "(?s)^[^:]*:(.*)", 1)
    shown = F.concat(_encoded(user, USER), let(password, lambda p: F.when(p != "", F.concat(F.lit(":"), _encoded(p, USER))).otherwise("")), F.lit("@"))
    return F.when(text.rlike("^:?$"), "").otherwise(shown)


def _port(digits: Column, scheme: Column) -> Column:
    default = F.coalesce(*(F.when(scheme == s, F.lit(p)) for s, p in PORTS.items()), F.lit(""))
    shown = lambda d: F.when((d == "") | (d == default), "").when(d.rlike("^[0-9]{1,5}$"), F.when(d.cast("int") <= 65535, F.concat(F.lit(":"), d)))
    return let(F.regexp_replace(digits, "^0+(?=.)", ""), shown)


def _place(text: Column, scheme: Column) -> Column:
    """//user:password@host:port from the text of an authority; null where it is none."""

    def shown(g: Column) -> Column:
        alone = (g.user == "") & (g.port == "")
        host = F.when(g.host != "", _host(g.host, scheme.isin(*SPECIAL))).when(~scheme.isin(*PORTS) & alone, "")
        local = let(host, lambda h: F.when(scheme == "file", F.when(alone, F.regexp_replace(h, "^localhost$", ""))).otherwise(h))
        return F.concat(F.lit("//"), _login(g.user), local, _port(g.port, scheme))

    groups = F.struct(*(F.regexp_extract(text, PLACE, i).alias(n) for i, n in ((1, "user"), (2, "host"), (3, "port"))))
    return F.when(text.rlike(PLACE), let(groups, shown))


def _serialised(u: Column) -> Column:
    def cut(p: Column) -> Column:
        """The text of an authority, if there is one, and the path as it is written."""
        web, special = p.scheme.isin(*PORTS), p.scheme.isin(*SPECIAL)

        def parted(body: Column) -> Column:
            drive = (p.scheme == "file") & body.rlike("^/{0,3}[A-Za-z][:|](/|$)")
            after = F.when(web, F.regexp_replace(body, "^/*", "")).when(~drive & body.startswith("//"), F.substring(body, F.lit(3), F.length(body)))
            bare = F.when(drive, F.regexp_replace(body, "^/*([A-Za-z]).", "/$1:")).otherwise(body)
            rooted = lambda r: F.when(special, F.regexp_replace(r, "^(?!/)", "/")).otherwise(r)
            return let(after, lambda a: F.struct(F.regexp_extract(a, "^[^/]*", 0).alias("place"), rooted(F.coalesce(F.regexp_replace(a, "^[^/]*", ""), bare)).alias("rest")))

        return let(F.when(special, F.translate(p.body, "\\", "/")).otherwise(p.body), parted)

    def built(p: Column) -> Column:
        special = p.scheme.isin(*SPECIAL)

        def whole(c: Column) -> Column:
            place = F.when(c.place.isNotNull(), _place(c.place, p.scheme)).when(p.scheme == "file", "//").otherwise("")
            path = F.when(c.rest.startswith("/"), _undotted(_encoded(c.rest, PATH))).otherwise(_encoded(c.rest, CONTROLS))
            apart = let(path, lambda x: F.when(c.place.isNull() & x.startswith("//") & ~special, F.concat(F.lit("/."), x)).otherwise(x))
            search = _encoded(p.search, QUERY)
            quoted = F.when(special, F.replace(search, F.lit("'"), F.lit("%27"))).otherwise(search)
            return F.concat(p.scheme, F.lit(":"), place, apart, quoted, _encoded(p.fragment, FRAGMENT))

        return let(cut(p), whole)

    group = lambda i: F.regexp_extract(u, WHOLE, i)
    parts = F.struct(F.lower(group(1)).alias("scheme"), group(2).alias("body"), group(3).alias("search"), group(4).alias("fragment"))
    return F.when(u.rlike(WHOLE), let(parts, built))


def href(url: Column) -> Column:
    """The absolute URL in the one form that the standard writes; null where the text is no absolute URL."""
    return F.when(url.rlike(PLAIN), url).otherwise(let(stripped(url), _serialised))
