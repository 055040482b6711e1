"""Places in the order of the tree, days of named zones, limits of the named functions."""

import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from stratarc import api
from stratarc.operators import stats, tree


def test_places_are_dense_and_in_order(spark):
    r = random.Random(4)
    uris = sorted({f"http://h{r.randrange(3)}.example/" + "/".join(r.choice(["a", "B", "part"]) + str(r.randrange(120)) for _ in range(1 + r.randrange(3))) for _ in range(400)})
    nodes = tree.nodes(spark.createDataFrame([(u,) for u in uris], "uri string"))
    got = sorted(tree.numbered(tree.visible_rows(nodes)).collect(), key=lambda x: x.pos)
    assert [x.pos for x in got] == list(range(nodes.count()))

    def key(url):
        steps = url.split("://")[1].rstrip("/").split("/")
        return [("".join(c for c in s.lower() if not c.isdigit()), int("".join(c for c in s if c.isdigit())), s) for s in steps[1:]]

    want = sorted((x.node for x in got), key=lambda u: (u.split("/")[2], key(u)))
    assert [x.node for x in got] == want
    assert tree.numbered(tree.visible_rows(nodes.where("false"))).count() == 0


def test_one_host_with_most_nodes_is_many_ranges(spark):
    rows = spark.range(4000).select(F.concat(F.lit("http://one.example/"), F.col("id").cast("string")).alias("uri"))
    placed = tree.numbered(tree.visible_rows(tree.nodes(rows)))
    assert {x.node: x.pos for x in placed.collect()} == {"http://one.example/": 0, **{f"http://one.example/{i}": i + 1 for i in range(4000)}}


def test_nodes_of_any_depth_are_kept_and_placed(spark, tmp_path):
    import duckdb

    from stratarc.plans.catalogue import QUERIES, SQL

    deep = "http://deep.example/" + "/".join(f"s{k}" for k in range(130))
    urls = [f"{deep}/x?page=2", f"{deep}/x?page=21", f"{deep}/page=2", f"{deep}/z", "http://flat.example/a?page=2", "http://flat.example/b"]
    c = duckdb.connect()
    c.execute("CREATE TABLE pages AS SELECT i::BIGINT AS page_id, u AS url, '<p>' AS html FROM (SELECT unnest(?) AS u, unnest(range(6)) AS i)", [urls])
    c.execute("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_minutes(i) AS ts, i % 5 AS user_id, 'view' AS event_type, 1.0 AS value, '' AS props FROM range(60) r(i)")
    for t in ("pages", "events"):
        c.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    got = sorted(tuple(r) for r in QUERIES["tree_rows"](spark, str(tmp_path)).collect())
    want = sorted(c.execute(SQL["tree_rows"]).fetchall())
    assert got == want and max(depth for _, depth, *_ in got) > 130

    kept = QUERIES["tree_filter"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in kept.collect()) == sorted(c.execute(SQL["tree_filter"]).fetchall())
    all_nodes = sorted(tuple(r) for r in QUERIES["tree_positions"](spark, str(tmp_path)).collect())
    assert all_nodes == sorted(c.execute(SQL["tree_positions"]).fetchall())


def test_a_deep_nodes_key_is_not_the_square_of_its_length(spark):
    deep = "http://deep.example/" + "/".join(f"s{k}" for k in range(500))
    rows = tree.visible_rows(tree.nodes(spark.createDataFrame([(deep,)], "uri string")))
    sizes = [(len(r.node), sum(len(x.url) for x in r.sort_key)) for r in rows.collect()]
    assert len(sizes) == 501 and all(a == b for a, b in sizes)


def test_days_of_a_zone_with_daylight_saving(spark):
    start = datetime(2024, 3, 9)
    moments = [start + timedelta(minutes=30 * k) for k in range(120)] + [datetime(2024, 11, 2) + timedelta(minutes=30 * k) for k in range(120)] + [None]
    rows = spark.createDataFrame([("u", m) for m in moments], "uri string, archived_ts timestamp_ntz")
    for zone in ("America/New_York", "Europe/Berlin", "Asia/Kathmandu"):
        want: dict = {}
        for m in moments:
            day = m.replace(tzinfo=timezone.utc).astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d") if m else "invalid"
            want[day] = want.get(day, 0) + 1
        assert {x.day: x.n for x in stats.timeline_days(rows, zone).collect()} == want
        assert stats.distinct_days(rows, zone).first().days == len(want)


def test_limits(spark):
    rows = spark.createDataFrame([(f"http://e.example/{i:02d}", f"text/x{i % 4}", f"c{i}", 1, None) for i in range(40)], "uri string, content_type_raw string, custom_id string, payload_size long, archived_ts timestamp_ntz")
    size = lambda **k: api.search_archive(rows, "", **k).count()
    assert (size(), size(limit=3), size(limit=0), size(limit=99), size(limit=25, page=2)) == (16, 3, 1, 25, 15)
    assert sorted(x.uri for x in api.search_archive(rows, "", after=(1, "http://e.example/05"), limit=2).collect()) == ["http://e.example/06", "http://e.example/07"]
    assert [x.content_type for x in api.list_content_types(rows, 2).collect()] == ["text/x0", "text/x1"]
    assert api.list_content_types(rows).count() == 4
