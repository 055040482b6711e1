"""Stream steps whose results depend on the order of micro-batches."""

import random

from pyspark.sql import functions as F

from stratarc.streaming import live


def _files(spark, path, batches, schema):
    import time

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path / "in"))
        time.sleep(1.1)  # files are read in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))


def test_trimmed_notices_are_reported_again(spark, tmp_path):
    batches = [[("a", "x", 1), ("b", "x", 2), ("a", "x", 3)], [("c", "x", 4), ("b", "x", 5)], [("a", "x", 6)]]
    stream = _files(spark, tmp_path, batches, "target string, reason string, seq long")
    got = live.live_notices(stream, f"file://{tmp_path}/out", keep=2)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "x", 6), ("c", "x", 4)]  # a was trimmed by c


def test_notices_after_a_restart_and_without_rows(spark, tmp_path):
    schema = "target string, reason string, seq long"
    out = f"file://{tmp_path}/out"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))
    assert live.live_notices(_files(spark, tmp_path, [], schema), out, keep=3).count() == 0
    assert live.live_notices(_files(spark, tmp_path, [[("a", "x", 1), ("b", "x", 2)]], schema), out, keep=3).count() == 2
    assert live.live_notices(_files(spark, tmp_path, [], schema), out, keep=3).count() == 2  # nothing new
    got = live.live_notices(_files(spark, tmp_path, [[("a", "x", 3), ("c", "x", 4)], [("d", "x", 5)]], schema), out, keep=3)
    assert sorted(r.target for r in got.collect()) == ["b", "c", "d"]


CAPTURE = "custom_id string, uri string, file_name string, byte_offset long, archived_ts timestamp, rec_type string, status int, location string, payload_size long, content_type string, digest string, refers_to_uri string, refers_to_date timestamp"


def _mixed(seed, n):
    """Donors and revisits over few digests and URIs and a month, with ties in time and place."""
    from datetime import datetime, timedelta

    r = random.Random(seed)
    at = lambda: datetime(2024, 1, 1) + timedelta(hours=r.randrange(24 * 30))
    rows = []
    for i in range(n):
        digest, uri = r.choice(["d1", "d2", "d3", f"d{i}", None]), r.choice(["u1", "u2", f"u{i}"])
        if r.random() < 0.5:
            rows.append((f"r{i}", uri, "f", i, at(), "revisit", None, None, None, "", digest, r.choice(["u1", "u2", "none", None]), r.choice([at(), None])))
        else:
            rows.append((f"c{i}", uri, r.choice(["f", "g"]), r.randrange(50), at(), "response", 200, None, r.choice([5, 9, None]), "text/html", digest, None, None))
    return rows


def _donors(df):
    return {r.custom_id: (r.via, r.d) for r in df.select("custom_id", "via", F.col("donor.custom_id").alias("d")).collect()}


def test_donors_do_not_depend_on_the_order_of_batches(spark, tmp_path):
    from stratarc.operators.resolve import resolve_revisits

    rows = _mixed(3, 240)
    want = _donors(resolve_revisits(spark.createDataFrame(rows, CAPTURE)).where("donor IS NOT NULL"))
    assert len(want) > 80 and {v for v, _ in want.values()} == {"digest", "uri"}
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        at = tmp_path / str(seed)
        stream = _files(spark, at, [rows[:50], rows[50:130], rows[130:]], CAPTURE)
        assert _donors(live.late_revisits(stream, f"file://{at}/out")) == want


def test_donors_after_a_restart_and_without_rows(spark, tmp_path):
    from stratarc.operators.resolve import resolve_revisits

    out = f"file://{tmp_path}/out"
    spark.createDataFrame([], CAPTURE).write.parquet(str(tmp_path / "in"))
    assert _donors(live.late_revisits(_files(spark, tmp_path, [], CAPTURE), out)) == {}
    rows = _mixed(4, 120)
    for part in (rows[:60], [], rows[60:], rows[:10]):  # nothing new, new rows, rows that come again
        got = _donors(live.late_revisits(_files(spark, tmp_path, [part] if part else [], CAPTURE), out))
    assert got == _donors(resolve_revisits(spark.createDataFrame(rows, CAPTURE)).where("donor IS NOT NULL"))


def test_a_revisit_may_come_before_its_donor(spark, tmp_path):
    from datetime import datetime

    at = lambda day: datetime(2024, 1, day)
    schema = "custom_id string, uri string, file_name string, byte_offset long, archived_ts timestamp, rec_type string, status int, location string, payload_size long, content_type string, digest string, refers_to_uri string, refers_to_date timestamp"
    revisit = lambda n, digest: (n, "u", "f", 1, at(2), "revisit", None, None, None, "", digest, None, None)
    donor = lambda n, digest: (n, "u", "f", 2, at(1), "response", 200, None, 5, "text/html", digest, None, None)
    stream = _files(spark, tmp_path, [[revisit("r1", "d1"), revisit("r2", "d2")], [donor("x", "d1")], [donor("y", "d2"), revisit("r3", "d1"), revisit("r4", "none")]], schema)
    got = live.late_revisits(stream, f"file://{tmp_path}/out").select("custom_id", F.col("donor.custom_id").alias("d")).collect()
    assert sorted(tuple(r) for r in got) == [("r1", "x"), ("r2", "y"), ("r3", "x")]


def test_all_notices_are_kept_without_a_limit(spark, tmp_path, sf_dir):
    batches = [[("a", "x", 3), ("b", "x", 2)], [("a", "x", 1), ("c", "y", 4)]]
    got = live.live_notices(_files(spark, tmp_path, batches, "target string, reason string, seq long"), f"file://{tmp_path}/out", keep=None)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "x", 1), ("b", "x", 2), ("c", "y", 4)]

    from stratarc.plans.catalogue import QUERIES, SQL

    assert "LIMIT" not in SQL["stream_notices"] and QUERIES["stream_notices"](spark, sf_dir).count() > 60


class _State:
    def __init__(self):
        self.held = {}

    def exists(self):
        return None in self.held

    def get(self):
        return self.held[None]

    def update(self, value):
        self.held[None] = value

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key] = value


class _Handle:
    def getValueState(self, *_):
        return _State()

    getMapState = getValueState


def test_a_days_rows_are_not_compared_with_one_another():
    import sys

    from pyspark.sql import Row

    n, day = 1500, live.DAY
    donor = lambda k: Row(custom_id=f"c{k}", at=3 * day + 20 * k, donor=Row(file_name="f", byte_offset=k, custom_id=f"c{k}", status=200, location=None, payload_size=5, content_type=""))
    revisit = lambda k: Row(custom_id=f"r{k}", at=3 * day + 20 * k + 7, donor=None)
    work = live.NearestDonors()
    work.init(_Handle())
    calls = 0

    def count(_frame, event, _arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        first = list(work.handleInputRows(("digest", "d"), [donor(k) for k in range(0, n, 2)] + [revisit(k) for k in range(n)], None))
        then = list(work.handleInputRows(("digest", "d"), [donor(k) for k in range(1, n, 2)] + [revisit(0)], None))
    finally:
        sys.setprofile(None)
    assert {r.custom_id: r.donor_id for r in first} == {f"r{k}": f"c{k if k % 2 == 0 else min(k + 1, n - 2)}" for k in range(n)}
    assert {r.custom_id: r.donor_id for r in then} == {f"r{k}": f"c{k}" for k in range(1, n, 2)}
    assert calls < 200 * n  # a few for each row; before, one for each pair of a day
