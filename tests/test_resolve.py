"""Lookups, revisits and redirects on small hand-made archives; streams against their batch twins; snapshots; the API."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stratarc import api
from stratarc.operators import asof, resolve, search
from stratarc.sources.snapshots import publish, read_newest

SCHEMA = "custom_id string, uri string, rec_type string, day int, status int, location string, payload_size bigint, digest string, refers_to_uri string, file_name string"


def archive(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select(
        "*",
        F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.col("day"), F.lit(0), F.lit(0), F.lit(0)).alias("archived_ts"),
        F.lit(None).cast("timestamp_ntz").alias("refers_to_date"),
        F.lit("text/html").alias("content_type"),
        F.lit("text/html").alias("content_type_raw"),
        F.monotonically_increasing_id().alias("byte_offset"),
        F.col("custom_id").alias("uuid"),
        F.lit(None).cast("string").alias("concurrent_to"),
    )


@pytest.fixture(scope="module")
def redirects(spark):
    return archive(
        spark,
        [
            ("big", "http://e/big", "response", 2, 301, "/end", 512, None, None, "f"),
            ("bare", "http://e/bare", "response", 2, 301, "/end", None, None, None, "f"),
            ("stub", "http://e/stub", "response", 2, 302, "/big", 166, None, None, "f"),
            ("lost", "http://e/lost", "response", 2, 302, "/gone", None, None, None, "f"),
            ("loop", "http://e/loop", "response", 2, 302, "/loop", 10, None, None, "f"),
            ("end", "http://e/end", "response", 2, 200, None, 9, "d1", None, "f"),
            ("end5", "http://e/end", "response", 5, 200, None, 9, "d2", None, "g"),
            ("rev", "http://e/rev", "revisit", 4, None, None, None, "d2", None, "f"),
            ("rev2", "http://e/rev2", "revisit", 4, None, None, None, None, "http://e/end", "f"),
            ("rev3", "http://e/rev3", "revisit", 4, None, None, None, "dx", None, "f"),
            ("req", "http://e/req", "request", 4, None, None, None, None, None, "f"),
        ],
    ).cache()


def look(spark, urls, day=2):
    return spark.createDataFrame([(u, u) for u in urls], "lookup_id string, url string").withColumn("near", F.lit(datetime(2024, 1, day)).cast("timestamp_ntz"))


def test_chains(spark, redirects):
    urls = [f"http://e/{n}" for n in ("big", "bare", "stub", "lost", "loop", "end", "nowhere", "req", "rev3")]
    final, hops = resolve.follow_redirects(look(spark, urls), redirects)
    got = {r.lookup_id.rsplit("/", 1)[1]: (r.outcome, r.custom_id, r.hops) for r in final.collect()}
    assert got == {
        "big": ("hit", "end", 1), "bare": ("hit", "end", 1), "stub": ("hit", "end", 2), "lost": ("not-archived", None, 1), "loop": ("redirect", None, 1),
        "end": ("hit", "end", 0), "nowhere": ("not-archived", None, 0), "req": ("no-payload", None, 0), "rev3": ("no-payload", None, 0),
    }
    assert hops.where("lookup_id = 'http://e/stub'").count() == 3


def test_stop_at_body(spark, redirects):
    final, _ = resolve.follow_redirects(look(spark, ["http://e/bare", "http://e/stub"]), redirects, stop_at_body=True)
    got = {r.lookup_id: (r.custom_id, r.redirects_to) for r in final.collect()}
    assert got == {"http://e/bare": ("end", None), "http://e/stub": ("stub", "http://e/big")}
    own = {r.lookup_id: r.custom_id for r in resolve.from_captures(redirects, redirects.where("custom_id IN ('big', 'bare')").select("custom_id")).collect()}
    assert own == {"big": "big", "bare": "end"}


def test_revisits(spark, redirects):
    got = {r.custom_id: (r.donor and r.donor.custom_id, r.via) for r in resolve.resolve_revisits(redirects).collect()}
    assert got == {"rev": ("end5", "digest"), "rev2": ("end5", "uri"), "rev3": (None, None)}
    shown = {r.custom_id: r for r in resolve.candidates(redirects).collect()}
    assert shown["rev"].file_name == "g" and shown["rev"].uri == "http://e/rev" and shown["rev"].status == 200
    rate = {r.scope: (r.revisits, r.resolved) for r in resolve.revisit_rate(redirects).collect()}
    assert rate == {"own file": (3, 1), "all files": (3, 2)}


def test_nearest_ties_and_missing_dates(spark):
    cands = archive(spark, [("b", "k", "response", 3, 200, None, 1, None, None, "g"), ("a", "k", "response", 1, 200, None, 1, None, None, "f"), ("c", "k", "response", 3, 200, None, 1, None, None, "f")]).withColumnRenamed("uri", "key")
    asked = spark.createDataFrame([("mid", "k", 2), ("late", "k", 9), ("none", "k", None), ("odd", "x", 2), ("null", None, 2)], "lookup_id string, key string, d int").withColumn("near", F.expr("make_timestamp_ntz(2024, 1, d, 0, 0, 0)"))
    got = {r.lookup_id: r.hit and r.hit.custom_id for r in asof.nearest(asked, cands).collect()}
    assert got == {"mid": "a", "late": "c", "none": "c", "odd": None, "null": None}


def test_api(spark, redirects):
    assert api.get_capture_as_of(redirects, "http://e/end#x").first().custom_id == "end5"
    assert [r.custom_id for r in api.resolve_redirect_chain(redirects, "http://e/stub").collect()] == ["stub", "big", "end5"]
    assert api.get_loaded_timeline(redirects, "http://e/end").count() == 2
    assert api.search_archive(redirects, "E/RE").count() == 4
    assert api.describe_loaded_archive(redirects).first().responses == 7
    assert api.list_content_types(redirects).first().nodes == 10
    assert api.find_loaded_capture_as_of(redirects, "http://e/big", stop_at_body=True).first().custom_id == "big"
    assert api.get_capture_detail(redirects, "end").count() == 1


def test_half_a_cursor_is_none(spark, redirects):
    whole = search.keyset_page(redirects, "", None, "x").count()
    assert whole == search.keyset_page(redirects, "", None, None).count() == 10
    assert search.keyset_page(redirects, "", 1, "http://e/end").count() < whole


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    seed = spark.createDataFrame([("seed",)], "status string")
    assert read_newest(spark, root, "status") is None
    assert read_newest(spark, root, "status", seed).first().status == "error"
    assert not publish(seed.where("false"), root, "status", "2024-01-01")
    assert not publish(seed, root, "status", "2024-01-01", healthy=False)
    assert publish(seed.withColumn("n", F.lit(1)), root, "status", "2024-01-02") and publish(seed.withColumn("n", F.lit(2)), root, "status", "2024-01-01")
    got = read_newest(spark, root, "status").first()
    assert got.n == 1 and got.stale and got.saved_at == datetime(2024, 1, 2)
    assert not read_newest(spark, root, "status", live=seed).first().stale


def test_hot_key_is_many_leaves(spark, monkeypatch):
    """One URL, most of it on one day, with ties in time and distance; three levels of nodes, and keys with few captures beside it."""
    import random

    monkeypatch.setattr(asof, "NODE", 4)
    r = random.Random(8)
    cands = [("hot", f"f{r.randrange(3)}", r.randrange(9), f"c{i}", 1_000_000 * (r.randrange(400) if i % 3 else r.randrange(10**6))) for i in range(300)]
    cands += [(f"k{i % 5}", "f", i, f"d{i}", 1_000_000 * r.randrange(500)) for i in range(12)] + [("k0", "f", 1, "none", None), (None, "f", 1, "no key", 5)]
    asks = [(f"l{i}", r.choice(["hot", "hot", "k0", "k1", "gone", None]), r.choice([None, 500_000, *(1_000_000 * r.randrange(500) + r.choice([0, 500_000]) for _ in range(9))])) for i in range(200)]
    ts = F.timestamp_micros("us")
    c = spark.createDataFrame(cands, "key string, file_name string, byte_offset long, custom_id string, us long").withColumn("archived_ts", ts)
    asked = spark.createDataFrame(asks, "lookup_id string, key string, us long").withColumn("near", ts)
    index = asof.time_index(c)
    assert len(index.upper) >= 3 and index.leaves.agg(F.max(F.size("__moments"))).first()[0] <= 6
    got = {x.lookup_id: x.hit and x.hit.custom_id for x in asof.nearest(asked, index).collect()}
    for name, key, at in asks:
        own = [x for x in cands if x[0] == key and key is not None and x[4] is not None]
        if at is None:
            best = max(own, key=lambda x: (x[4], [-ord(s) for s in x[1]], -x[2], [-ord(s) for s in x[3]]), default=None)
        else:
            best = min(own, key=lambda x: (abs(x[4] - at), x[1:4]), default=None)
        assert got[name] == (best and best[3]), (name, key, at)


def test_donors_are_written_once_and_details_only_for_loops(spark, sf_dir, monkeypatch):
    """One numbering serves lookups by digest and by URI; no table of details is written for a single lookup."""
    from stratarc.operators import asof, resolve
    from stratarc.plans.fixture import captures

    made = []
    for name in ("stored", "stored_by"):
        real = getattr(asof, name)
        monkeypatch.setattr(asof, name, lambda df, *a, real=real: made.append(a[-1]) or real(df, *a))
    resolve.resolve_revisits(captures(spark, sf_dir))
    assert made.count("numbered") == 1 and made.count("leaves") == 2 and "details" not in made


def test_places_by_halves(spark):
    """As many moments as are at most the limit, for arrays of every length a node can have."""
    from pyspark.sql import functions as F

    from stratarc.operators.asof import NODE, _up_to

    sizes = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 1000, NODE - 1, NODE, NODE + 1, NODE + 2)], "n int")
    rows = sizes.withColumn("v", F.expr("transform(sequence(0, n), x -> 3L * x)")).withColumn("v", F.slice("v", 1, F.col("n")))
    rows = rows.withColumn("x", F.explode(F.array(*(F.lit(x) for x in (-1, 0, 1, 3, 3070, 3071, 3072, 3075, 1 << 62)))))
    assert rows.where(_up_to("v", F.col("x")) != F.size(F.filter("v", lambda m: m <= F.col("x")))).count() == 0
