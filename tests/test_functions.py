"""Column functions on hand-made values."""

from pyspark.sql import functions as F

from stratarc.functions import headers as H
from stratarc.functions import urls as U
from stratarc.operators import search


def values(spark, kind, items, column):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_header_takes_first_in_any_case(spark):
    df = spark.createDataFrame([({"content-type": "a", "Content-Type": "b"},), (None,), ({},)], "m map<string,string>")
    assert [r[0] for r in df.select(H.header(F.col("m"), "Content-Type")).collect()][0] in ("a", "b")
    assert [r[0] for r in df.select(H.header(F.col("m"), "Content-Type")).collect()][1:] == [None, None]


def test_numbers_and_dates(spark):
    assert values(spark, "string", ["12", "", " ", "x", None, "1.5"], H.number_or_null) == [12.0, 0.0, 0.0, None, None, 1.5]
    got = values(spark, "string", ["2024-01-02T03:04:05Z", "Tue, 02 Jan 2024 03:04:05 GMT", "soon", None], H.date_or_null)
    assert got[0] == got[1] and got[2:] == [None, None]


def test_ids(spark):
    assert values(spark, "string", ["<urn:uuid:a-1>", "urn:uuid:b", "c", None], H.record_uuid) == ["a-1", "b", "c", ""]
    assert values(spark, "string", [" <http://a/> ", "b"], H.unwrap_angle) == ["http://a/", "b"]
    parts = values(spark, "string", ["f::http://[::1]/x::u"], H.custom_id_parts)[0]
    assert (parts.file_name, parts.url, parts.uuid) == ("f", "http://[::1]/x", "u")


def test_content_types(spark):
    assert values(spark, "string", ["Text/HTML;charset=x", None, ""], H.content_essence) == ["text/html", "", ""]
    assert values(spark, "string", ["a/b ;c=d"], H.content_type_full) == ["a/b; c=d"]
    assert values(spark, "string", ["text/html", "foo/bar", "text", None], H.usable_content_type) == [True, False, False, False]


def test_canonical_url(spark):
    given = ["HTTP://Www.Example.COM:80/a/./b/../c?x#y", "https://e.com", "https://e.com:8443/", "dns:e.com", "not a url", "https://u@e.com/a b", None]
    assert values(spark, "string", given, U.canonical_url) == ["http://www.example.com/a/c?x#y", "https://e.com/", "https://e.com:8443/", "dns:e.com", "not a url", "https://u@e.com/a%20b", None]


def test_url_places(spark):
    given = ["onion://abc/x", "urn:x:y", "data:text/plain,x", "about:blank", "::", "https://www.e.com:8443/a//b/?b=2&a=1"]
    reasons = [p.reason for p in values(spark, "string", given, U.url_parts)]
    assert reasons == [None, "not-a-web-url", "not-a-web-url", "not-a-web-url", "unparseable", None]
    assert values(spark, "string", given, U.node_path)[-1] == ["https://www.e.com:8443/", "https://www.e.com:8443/a", "https://www.e.com:8443/a/b", "https://www.e.com:8443/a/b?a=1&b=2"]
    assert values(spark, "string", given, lambda c: U.node_url(c, True))[0] == "abc/x"
    assert values(spark, "string", given, U.node_path)[0] is None


def test_queries_sort_by_key_and_keep_repeats(spark):
    assert values(spark, "string", ["http://e/?id=3&b=f", "http://e/?a=2&a=1", "http://e/?", "http://e/"], U.canonical_query) == ["b=f&id=3", "a=2&a=1", "", ""]


def test_parents(spark):
    given = ["https://a.com/", "https://a.com/n", "https://a.com/n/m", "https://a.com/n?q=1", "a.com/n", "a.com/"]
    assert values(spark, "string", given, U.parent_url) == [None, "https://a.com/", "https://a.com/n", "https://a.com/n", "a.com/", None]


def test_lookup_keys(spark):
    assert values(spark, "string", ["http://e.com/a?b=1&a=2#x", "http://e.com/a"], U.lookup_keys) == [["http://e.com/a?b=1&a=2#x", "http://e.com/a?b=1&a=2", "http://e.com/a?a=2&b=1"], ["http://e.com/a"]]


def test_redirect_targets(spark):
    rows = [(301, "/x", "http://e.com/a/b"), (302, "y?z", "http://e.com/a/b"), (303, "//o.com", "https://e.com/"), (307, "../up", "http://e.com/a/b/c"), (308, "?q", "http://e.com/a"), (300, "/x", "http://e.com/"), (301, " ", "http://e.com/"), (301, None, "http://e.com/")]
    df = spark.createDataFrame(rows, "s int, l string, u string").withColumn("t", U.redirect_target(F.col("s"), F.col("l"), F.col("u")))
    assert [r.t for r in df.collect()] == ["http://e.com/x", "http://e.com/a/y?z", "https://o.com/", "http://e.com/a/up", "http://e.com/a?q", None, None, None]


def test_slugs_round_trip(spark):
    given = ["a b", "100%", "50%25", "é+ü", "all", ".", "..", "a/b?c#d&e=f", "%2F", "", "🙂"]
    slugs = values(spark, "string", given, U.query_slug)
    assert values(spark, "string", slugs, U.query_from_slug) == given
    assert slugs[-2] == "all" and len(set(slugs)) == len(slugs)


def test_failure_kinds(spark):
    rows = [(503, None, None), (404, None, None), (401, None, None), (429, None, None), (500, None, None), (418, None, None), (None, "SyntaxError", None), (None, "AbortError", None), (None, "X", "it timed out"), (None, None, None)]
    df = spark.createDataFrame(rows, "s int, e string, m string").select(H.failure_kind(F.col("s"), F.col("e"), F.col("m")).alias("f"))
    assert [r.f.kind for r in df.collect()] == ["timeout", "missing", "denied", "throttled", "server", "rejected", "malformed", "timeout", "timeout", "offline"]


def test_page_counts(spark):
    got = values(spark, "double", [0.0, 1.0, 16.0, 17.0, 9999.0, 5000000.0, -5.0, None, float("nan"), float("inf")], search.page_count)
    assert got == [1, 1, 1, 2, 625, 626, 1, 1, 1, 626]


def test_natural_order(spark):
    given = ["part12.txt", "part3.txt", "Index", "index", "part90210.txt"]
    keys = dict(zip(given, values(spark, "string", given, search.natural_key)))
    assert sorted(given[:2] + given[4:], key=keys.get) == ["part3.txt", "part12.txt", "part90210.txt"] and keys["Index"] == keys["index"]


def test_query_is_a_sorted_form(spark):
    """Decoded, sorted by key (equal keys in their order) and serialised as a form does; expected values by urllib."""
    from urllib.parse import parse_qsl, urlencode

    odd = ["q=b%20c", "q=b+c", "b=2&a=1", "a=2&a=1", "x", "x=", "=v", "a=b=c", "&&a=1&", "k=%C3%A9", "k=é", "k=~(x)!'*", "s=a/b?c", "z=1&%61=2"]
    urls = [f"http://e.com/p?{q}#f" for q in odd]
    got = {r.u: r.q for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.canonical_query(F.col("u")).alias("q")).collect()}
    for u, q in zip(urls, odd):
        pairs = sorted(parse_qsl(q, keep_blank_values=True), key=lambda x: x[0])
        assert got[u] == urlencode(pairs, safe="*").replace("~", "%7E"), q
    plain = {r.u: r.q for r in spark.createDataFrame([("http://e.com/?",), ("http://e.com/",), ("http://e.com/?a=100%&b=%zz",), ("no url",), (None,)], "u string").select("u", U.canonical_query(F.col("u")).alias("q")).collect()}
    assert plain == {"http://e.com/?": "", "http://e.com/": "", "http://e.com/?a=100%&b=%zz": "a=100%25&b=%25zz", "no url": "", None: None}


HREFS = {
    "HTTP://E.com:80/a/./b/../c?x#y": "http://e.com/a/c?x#y",
    "http:\\\\e.com\\a\\b?c\\d": "http://e.com/a/b?c\\d",
    "http:e.com": "http://e.com/",
    "http:////e.com/x": "http://e.com/x",
    " \thttp://e.com/a\nb ": "http://e.com/ab",
    "http://e.com/a/%2e%2E/b/%2e": "http://e.com/b/",
    "http://e.com//a/..": "http://e.com//",
    "http://e.com./": "http://e.com./",
    "http://e.com?q": "http://e.com/?q",
    "http://e.com/%zz%41": "http://e.com/%zz%41",
    "http://bücher.de/é?ü#ß": "http://xn--bcher-kva.de/%C3%A9?%C3%BC#%C3%9F",
    "http://faß.de/": "http://xn--fa-hia.de/",
    "http://例え。テスト/": "http://xn--r8jz45g.xn--zckzah/",
    "http://ｅ．com/": "http://e.com/",
    "http://%65.com/": "http://e.com/",
    "http://e.com/a'b?a'b#a'b`": "http://e.com/a'b?a%27b#a'b%60",
    "http://e.com/{a}^|?{b}": "http://e.com/%7Ba%7D%5E|?{b}",
    "http://0x7f.1/": "http://127.0.0.1/",
    "http://017700000001": "http://127.0.0.1/",
    "http://3232235777/": "http://192.168.1.1/",
    "http://1.2.3.4.5/": None,
    "http://256.1.1.1/": None,
    "http://1.2.3.08/": None,
    "http://[2001:0DB8:0:0:1:0:0:1]:8080/": "http://[2001:db8::1:0:0:1]:8080/",
    "http://[::ffff:1.2.3.4]/": "http://[::ffff:102:304]/",
    "http://[1::2::3]/": None,
    "http://[1:2]/": None,
    "http://e.com:99999/": None,
    "http://e.com:8x/": None,
    "http://e.com:/": "http://e.com/",
    "https://e.com:0443/": "https://e.com/",
    "http://a b/": None,
    "http://e%00.com/": None,
    "http:///": None,
    "http://u@/": None,
    "http://:@e.com/": "http://e.com/",
    "http://u:@e.com/": "http://u@e.com/",
    "http://a@b@e.com/": "http://a%40b@e.com/",
    "http://u:p:q@e.com/": "http://u:p%3Aq@e.com/",
    "data:text/plain,a b<": "data:text/plain,a b<",
    "urn:x:É": "urn:x:%C3%89",
    "onion://AbC/x/../y": "onion://AbC/y",
    "x:/a/../..//b": "x:/.//b",
    "foo://:80/": None,
    "foo://h:80": "foo://h:80",
    "file:/a/b": "file:///a/b",
    "file://localhost/a": "file:///a",
    "file:///C|/x": "file:///C:/x",
    ":::not a url:::": None,
    "": None,
}


def test_hrefs_of_odd_urls(spark):
    """Values worked out by hand from the steps of the URL standard; an href is its own href."""
    from stratarc.functions.hrefs import href

    assert dict(zip(HREFS, values(spark, "string", list(HREFS), href))) == HREFS
    shown = sorted({h for h in HREFS.values() if h})
    assert values(spark, "string", shown, href) == shown
    places = [p.reason for p in values(spark, "string", shown + [u for u, h in HREFS.items() if h is None and u.startswith("http")], U.url_parts)]
    assert [r == "unparseable" for r in places] == [False] * len(shown) + [True] * (len(places) - len(shown))
    assert values(spark, "string", [u for u, h in HREFS.items() if h is None] + [None], U.canonical_url) == [u for u, h in HREFS.items() if h is None] + [None]


def test_punycode_and_ipv6_as_the_library_has_them(spark):
    import ipaddress
    import random

    from stratarc.functions.hrefs import _ipv6, _punycode

    draw = random.Random(5)
    labels = ["é" + "".join(draw.choice("abz09-éüßωжя例テ한🙂ñ") for _ in range(draw.randint(0, 40))) for _ in range(200)]
    assert values(spark, "string", labels, _punycode) == ["xn--" + x.encode("punycode").decode() for x in labels]
    long = ["é" * 3000 + "例" * 50]
    assert values(spark, "string", long, _punycode) == ["xn--" + x.encode("punycode").decode() for x in long]
    texts = [":".join(draw.choice(["0", "0", "0", "1", "ab", "ff"]) for _ in range(8)) for _ in range(200)]
    assert values(spark, "string", texts, _ipv6) == [f"[{ipaddress.IPv6Address(x).compressed}]" for x in texts]


def test_references_with_backslashes_and_odd_bases(spark):
    rows = [("http://e.com/a/b", "\\x\\y?q\\"), ("http://e.com/a/b", "c\td"), ("HTTP://E.com", "é"), ("http://e.com/", "http://e.com:99999/"), ("http://bad host/", "/x"), ("http://e.com/a", "  "), ("http://1.2.3.4.5/", "/x")]
    df = spark.createDataFrame(rows, "b string, r string").select(U.resolve_reference(F.col("b"), F.col("r")).alias("u"))
    assert [r.u for r in df.collect()] == ["http://e.com/x/y?q\\", "http://e.com/a/cd", "http://e.com/%C3%A9", None, None, None, None]
