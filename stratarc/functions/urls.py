"""URL columns (C6, C10-C17, C20-C22, C29), as Column expressions over one regular grammar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratarc.functions.headers import FOLLOWED
from stratarc.functions.hrefs import PORTS, href, stripped
from stratarc.functions.hrefs import let as _let

SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
#: scheme, //authority, authority, path, ?query, #fragment
GRAMMAR = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*):(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
#: Parts the groups of a matched URL; a character that no text has.
MARKER = "\uffff"


def _groups(url: Column) -> Column:
    """The six groups of the grammar, matched once; an array of another length where it does not match."""
    return F.split(F.regexp_replace(url, GRAMMAR, MARKER.join(f"${i}" for i in range(1, 7))), MARKER)


def _part(groups: Column, group: int) -> Column:
    return F.when(F.size(groups) == 6, F.get(groups, F.lit(group - 1))).when(groups.isNotNull(), "")


#: Host and port as a href has them: an address in brackets, four bytes, or a name whose last label is no number.
BYTE = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
HOST = (
    r"^(?:\[(?![^\]]*::[^\]]*::)(?=[^\]]*::|(?:[^:\]]*:){7}[^:\]]*\])[0-9a-f:]+\]"
    rf"|{BYTE}(?:\.{BYTE}){{3}}"
    r"|(?!(?:.*\.)?(?:[0-9]+|0x[0-9a-f]*)\.?(?::|$))[^\x00-\x20#%/:<>?@\[\\\]^|\x7f]+)"
    r"(?::(?:[0-9]{1,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5]))?$"
)


def _parses(g: Column) -> Column:
    """A scheme, and for schemes with an origin a host and port that a href can have."""
    web = F.lower(_part(g, 1)).isin(*PORTS)
    return F.coalesce((_part(g, 1) != "") & (~web | F.lower(F.regexp_replace(_part(g, 3), r"^[^@]*@", "")).rlike(HOST)), F.lit(False))


def _authority(g: Column) -> Column:
    """Lower-case host with its port, without a default port or credentials."""
    scheme = F.lower(_part(g, 1))
    default = F.coalesce(*(F.when(scheme == s, F.lit(f":{p}")) for s, p in PORTS.items()), F.lit(":"))
    return _let(F.lower(F.regexp_replace(_part(g, 3), r"^[^@]*@", "")), lambda host: F.when(host.endswith(default), F.regexp_replace(host, r":[0-9]*$", "")).otherwise(host))


def canonical_url(url: Column) -> Column:
    """The href of the URL; text that is no absolute URL stays as it is."""
    return F.coalesce(href(url), url)


def _parts(g: Column) -> Column:
    host, scheme = _authority(g), F.lower(_part(g, 1))

    def made(host: Column) -> Column:
        return F.struct(
            scheme.alias("scheme"),
            host.alias("host"),
            F.regexp_replace(host, r":[0-9]*$", "").alias("hostname"),
            F.when(scheme.isin(*PORTS), F.concat(scheme, F.lit("://"), host)).alias("origin"),
            F.filter(F.split(_part(g, 4), "/"), lambda s: s != "").alias("segments"),
            _sorted_query(_part(g, 5)).alias("query"),
            F.when(~_parses(g), "unparseable").when(host == "", "not-a-web-url").alias("reason"),
            F.when(_part(g, 4) == "", "/").otherwise(_part(g, 4)).alias("path"),
            _part(g, 5).alias("search"),
        )

    return _let(host, made)


def url_parts(url: Column) -> Column:
    """scheme, host, hostname, origin, segments, query of a URL as ``canonical_url`` leaves it; ``reason`` where it has no place in a tree."""
    return _let(_groups(url), _parts)


def _form_decoded(s: Column) -> Column:
    """``+`` is a space, %XX a byte; a percent sign without two hex digits is itself."""
    return F.when(s.rlike("[%+]"), F.try_url_decode(F.regexp_replace(s, "%(?![0-9A-Fa-f]{2})", "%25"))).otherwise(s)


def _form_encoded(s: Column) -> Column:
    return F.when(s.rlike("[^A-Za-z0-9*._-]"), F.url_encode(s)).otherwise(s)


def _sorted_query(search: Column) -> Column:
    """Form-encoded parameters sorted by key, equal keys in their order, from a query with its question mark."""

    def pair(p: Column, i: Column) -> Column:
        at = F.instr(p, "=")
        key = F.when(at > 0, F.substring(p, F.lit(1), at - 1)).otherwise(p)
        value = F.when(at > 0, F.substring(p, at + 1, F.length(p))).otherwise("")
        return F.struct(_form_decoded(key).alias("k"), i.alias("i"), _form_decoded(value).alias("v"))

    pairs = F.filter(F.split(F.substring(search, F.lit(2), F.length(search)), "&"), lambda p: p != "")
    shown = F.transform(F.array_sort(F.transform(pairs, pair)), lambda x: F.concat(_form_encoded(x.k), F.lit("="), _form_encoded(x.v)))
    return F.when(F.length(search) > 1, F.array_join(shown, "&")).when(search.isNotNull(), "")


def canonical_query(url: Column) -> Column:
    """Parameters decoded, sorted by key and serialised as a form; '' for none.  Keys sort by code point."""
    return _let(_groups(url), lambda g: _sorted_query(_part(g, 5)))


def normal_host(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"^www\.", "")


def node_path(url: Column, normal: bool = False) -> Column:
    """URLs of the tree nodes from the root down to the record's own; null where it has no place."""

    def built(p: Column) -> Column:
        base = normal_host(p.hostname) if normal else p.origin
        steps = F.transform(F.sequence(F.lit(0), F.size(p.segments)), lambda i: F.when(i == 0, F.concat(base, F.lit("/"))).otherwise(F.concat(base, F.lit("/"), F.array_join(F.slice(p.segments, F.lit(1), i), "/"))))
        whole = _let(steps, lambda x: F.when(p.query != "", F.concat(x, F.array(F.concat(F.element_at(x, -1), F.lit("?"), p.query)))).otherwise(x))
        return F.when(p.reason.isNull() & base.isNotNull(), whole)

    return _let(url_parts(url), built)


def node_url(url: Column, normal: bool = False) -> Column:
    return F.element_at(node_path(url, normal), -1)


def parent_url(node: Column) -> Column:
    """Before the query; else without the last segment; a root has none."""
    cut = F.regexp_replace(node, r"/[^/]*$", "")
    below = F.regexp_replace(cut, r"^[^/]*://", "")
    return (
        F.when(F.instr(node, "?") > 1, F.split_part(node, F.lit("?"), F.lit(1)))
        .when(node.endswith("/") | ~node.contains("/"), F.lit(None).cast("string"))
        .when(below.contains("/"), cut)
        .otherwise(F.concat(cut, F.lit("/")))
    )


def _bare(p: Column, url: Column) -> Column:
    return F.when(p.origin.isNotNull() & p.reason.isNull(), F.concat(p.origin, p.path, F.when(p.search == "?", "").otherwise(p.search))).otherwise(url)


def without_fragment(url: Column) -> Column:
    return _let(url_parts(url), lambda p: _bare(p, url))


def lookup_keys(url: Column) -> Column:
    """Up to three keys by priority: as given, without fragment, and with sorted query too."""

    def keys(p: Column) -> Column:
        sorted_ = F.when(p.origin.isNotNull() & p.reason.isNull(), F.concat(p.origin, p.path, F.when(p.query != "", F.concat(F.lit("?"), p.query)).otherwise(""))).otherwise(url)
        return F.array_distinct(F.array(url, _bare(p, url), sorted_))

    return _let(url_parts(url), keys)


def resolve_reference(base: Column, ref: Column) -> Column:
    """The absolute URL of a reference found on a page; null where there is none.  Backslashes are slashes, as on the web."""

    def joined(p: Column, r: Column) -> Column:
        folder = F.regexp_replace(p.path, r"[^/]*$", "")
        relative = (
            F.when(r.startswith("//"), F.concat(p.scheme, F.lit(":"), r))
            .when(r.startswith("/"), F.concat(p.origin, r))
            .when(r.startswith("?"), F.concat(p.origin, p.path, r))
            .when(r.startswith("#"), F.concat(p.origin, p.path, p.search, r))
            .otherwise(F.concat(p.origin, folder, r))
        )
        return F.when(r.rlike(SCHEME), r).otherwise(relative)

    slashes = lambda r: F.when(r.contains("\\") & ~r.rlike(SCHEME), F.concat(F.translate(F.regexp_extract(r, "^[^?#]*", 0), "\\", "/"), F.regexp_replace(r, "^[^?#]*", ""))).otherwise(r)
    r = _let(stripped(ref), slashes)
    return F.when(stripped(ref) != "", _let(url_parts(base), lambda p: _let(r, lambda r: href(joined(p, r)))))


def redirect_target(status: Column, location: Column, url: Column) -> Column:
    return F.when(status.isin(*FOLLOWED), resolve_reference(url, F.nullif(F.trim(location), F.lit(""))))


def same_target(a: Column, b: Column) -> Column:
    x, y = url_parts(a), url_parts(b)
    return (a == b) | F.coalesce((x.origin == y.origin) & (x.path == y.path) & (x.query == y.query), F.lit(False))


def _encoded(s: Column) -> Column:
    """Percent-encoding with the unreserved set A-Z a-z 0-9 - _ . ! ~ * ' ( )."""
    out = F.url_encode(s)
    for code, raw in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(raw))
    return out


def query_slug(q: Column) -> Column:
    text = F.trim(q)
    once = _encoded(text)
    slug = F.when(once.contains("%25"), _encoded(once)).otherwise(once)
    return F.when(text == "", "all").when(slug == "all", "%2561ll").when(slug.isin(".", ".."), F.replace(slug, F.lit("."), F.lit("%252E"))).otherwise(slug)


def query_from_slug(slug: Column) -> Column:
    plus = lambda s: F.replace(s, F.lit("+"), F.lit("%2B"))
    once = F.try_url_decode(plus(slug))
    twice = F.try_url_decode(plus(once))
    return F.when(slug == "all", "").otherwise(F.coalesce(twice, once, slug))


def site_label(uri: Column) -> Column:
    def shown(p: Column) -> Column:
        whole = F.concat(p.host, p.path, F.when(p.search == "?", "").otherwise(p.search))
        return F.when(p.reason.isNull() & p.host.isNotNull(), F.regexp_replace(whole, "/$", "")).otherwise(uri)

    return _let(url_parts(uri), shown)


def site_anchor(uri: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(uri, r"(?i)^[a-z]+://", ""), "[^A-Za-z0-9]+", "-")
    bare = F.substring(F.regexp_replace(bare, "^-+|-+$", ""), 1, 60)
    return F.concat(F.lit("site-"), F.when(bare == "", "x").otherwise(bare))


def export_name(url: Column, uuid: Column) -> Column:
    p = url_parts(url)
    path = F.replace(F.regexp_replace(p.path, "^/+|/+$", ""), F.lit("/"), F.lit("-"))
    web = p.reason.isNull()
    host = F.when(web, F.regexp_replace(p.hostname, r"^www\.", "")).otherwise("archive")
    stem = F.substring(F.concat_ws("-", F.nullif(host, F.lit("")), F.nullif(F.when(web, path), F.lit(""))), 1, 100)
    name = F.concat_ws("-", F.nullif(stem, F.lit("")), F.nullif(F.regexp_replace(F.regexp_replace(uuid, "(?i)^<?urn:uuid:", ""), ">$", ""), F.lit("")))
    safe = F.regexp_replace(F.regexp_replace(name, r'[<>:"|?*\\/\x00-\x1f\x7f]', "-"), "-+", "-")
    return F.concat(F.regexp_replace(safe, "^-|-$", ""), F.lit(".zip"))
