"""The WARC source on small hand-made files."""

import gzip
import io
import random
import zipfile

from pyspark.sql import functions as F

from stratarc.operators.captures import to_captures
from stratarc.operators.tree import untreed
from stratarc.sources import warc as W


def record(kind, uri=None, body=b"", http=None, n=0):
    block = (http.encode() + b"\r\n\r\n" if http else b"") + body
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{n}>", "WARC-Date: 2024-01-02T03:04:05Z", f"Content-Length: {len(block)}"]
    lines += [f"WARC-Target-URI: {uri}"] if uri else []
    lines += ["Content-Type: application/http; msgtype=response"] if http else []
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


OK = "HTTP/1.1 200 OK\r\nContent-Type: text/html"
CHUNKED = "HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked"
RECORDS = [
    record("warcinfo", n=0),
    record("request", "http://e.com/", n=1),
    record("response", "http://e.com/", b"<p>x</p>", OK, 2),
    record("response", "http://e.com/a", b"4\r\nabcd\r\n0\r\n\r\n", CHUNKED, 3),
    record("response", "http://e.com/b", b"", "HTTP/1.1 301 Moved\r\nLocation: /a", 4),
    record("revisit", "http://e.com/", n=5),
    record("metadata", n=6),
]


def test_plain_file(spark, tmp_path):
    (tmp_path / "tiny.warc").write_bytes(b"".join(RECORDS))
    wire = W.read_warc(spark, str(tmp_path)).cache()
    rows = {r.type + str(r.offset): r for r in wire.collect()}
    assert len(rows) == 7 and all(r._error is None for r in rows.values())
    caps = {r.uuid: r for r in to_captures(W.records(wire)).collect()}
    assert caps["3"].payload.chunks == [4] and caps["3"].payload.full_size == 4
    assert caps["4"].http.location == "/a" and caps["4"].payload is None
    assert caps["2"].payload.size == 8 and caps["2"].content_type == "text/html"
    left = {(r.rec_type, r.reason): r.expected for r in untreed(to_captures(W.records(wire)).withColumnRenamed("url", "uri")).collect()}
    assert left == {("warcinfo", "no url"): True, ("metadata", "no url"): True}


def in_ranges(data, edges, kind="plain"):
    """Offsets of the records of all ranges between the edges, each range guessed and chained as by pieces()."""
    part = W.Part(io.BytesIO(data), 0, len(data))
    split = W.split_members if kind == "gz" else W.split_records
    got, at, wrong = [], 0, 0
    for start, end in zip(edges, edges[1:]):
        first = W._guess(part, kind, start, end)
        if at is None or at >= end:
            continue
        wrong += first != at
        got += [r[3] for r in split(part, "t", at, end if end < len(data) else None)]
        at = W._walked(part, kind, at, end)
    return got, wrong


def offsets(data, kind="plain"):
    return [r[3] for r in (W.split_members if kind == "gz" else W.split_records)(io.BytesIO(data), "t")]


def bodies():
    """Bodies that hold what looks like starts of records: archives, whole and broken, one inside the other."""
    inner = b"".join(RECORDS[:3])
    return [inner, b"text\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nno record", b"\r\n\r\nWARC/1.0\r\n\r\n", record("resource", "http://e.com/in", inner, n=30)]


def test_every_cut_reads_each_record_once():
    """Also with two to six line breaks behind records, and bodies that are archives."""
    for breaks in range(2, 7):
        data = b"".join(r + b"\r\n" * (breaks - 2 if k % 2 else 0) for k, r in enumerate([*RECORDS, *(record("resource", "u", x) for x in bodies()), *RECORDS]))
        whole = offsets(data)
        assert len(whole) == 2 * len(RECORDS) + 4
        for cut in range(1, len(data)):
            assert in_ranges(data, [0, cut, len(data)])[0] == whole, (breaks, cut)


def test_many_ranges_and_wrong_guesses():
    data = b"".join([RECORDS[0], *(record("resource", f"http://e.com/{i}", b, n=10 + i) for i, b in enumerate(bodies())), RECORDS[2]])
    seen = 0
    for n in range(1, 60):
        got, wrong = in_ranges(data, [len(data) * i // n for i in range(n + 1)])
        assert got == offsets(data)
        seen += wrong
    assert seen  # some range took an embedded record for its first


def test_cut_members_and_stored_members_inside():
    """A body that is itself compressed and kept as it is looks like members of its own."""
    inside = b"".join(gzip.compress(r) for r in RECORDS[:3])
    data = b"".join(gzip.compress(r, 0) for r in [RECORDS[0], record("resource", "u", inside), *RECORDS[1:], record("resource", "v", inside)])
    whole, wrong = offsets(data, "gz"), 0
    assert len(whole) == len(RECORDS) + 2
    for cut in range(1, len(data)):
        got, off = in_ranges(data, [0, cut, len(data)], "gz")
        assert got == whole, cut
        wrong += off
    assert wrong


def test_broken_file_in_ranges(tmp_path, spark):
    """What stands before the break is read once, the break is reported once."""
    data = b"".join(RECORDS) * 30
    bad = data[: len(data) // 2] + b"junk" + data[len(data) // 2 :]
    (tmp_path / "b.warc").write_bytes(bad)
    rows = W.read_warc(spark, str(tmp_path), splitFrom=1, splitFloor=500).collect()
    whole = list(W.split_records(io.BytesIO(bad), "b.warc"))
    assert sorted(r.offset for r in rows if r._error is None) == [r[3] for r in whole if r[10] is None]
    assert [r._error.name for r in rows if r._error] == [r[10][1] for r in whole if r[10]] == ["ValueError"]


def test_one_file_is_many_tasks(spark, tmp_path):
    """Plain, compressed and inside a container: records once each, by several tasks; the member table has every member."""
    r = random.Random(1)
    many = [record("response", f"http://e.com/{i}", bytes(r.randrange(256) for _ in range(200)), OK, i) for i in range(300)]
    packed = [gzip.compress(x) for x in many]
    (tmp_path / "p.warc").write_bytes(b"".join(many))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(packed))
    with zipfile.ZipFile(tmp_path / "z.wacz", "w") as z:
        z.writestr("archive/stored.warc.gz", b"".join(packed))
        z.writestr("archive/small.warc", b"".join(many), zipfile.ZIP_DEFLATED)
    wire = W.read_warc(spark, str(tmp_path), splitFrom=20_000, splitFloor=10_000)
    found = wire.withColumn("task", F.spark_partition_id()).groupBy("file_name").agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"), F.count_distinct("task").alias("tasks"), F.count("_error").alias("bad"))
    got = {x.file_name: tuple(x)[1:] for x in found.collect()}
    assert {k: v[:2] + v[3:] for k, v in got.items()} == {k: (300, 300, 0) for k in ("p.warc", "c.warc.gz", "z.wacz › archive/stored.warc.gz", "z.wacz › archive/small.warc")}
    assert got["p.warc"][2] > 3 and got["c.warc.gz"][2] > 3 and got["z.wacz › archive/stored.warc.gz"][2] > 3 and got["z.wacz › archive/small.warc"][2] == 1
    table = W.members(W.pieces(W.archives(W.listing(spark, str(tmp_path))), 10_000, 20_000)).where("shown = 'c.warc.gz'").orderBy("offset").collect()
    assert [x.length for x in table] == [len(x) for x in packed] and all(x.payload_offset for x in table)
    located = {x.payload.gzip.compressed_offset: x.payload.gzip.payload_offset for x in wire.where("file_name = 'c.warc.gz'").collect()}
    assert located == {x.offset: x.payload_offset for x in table}


def test_growing_folder_gives_each_record_once(spark, tmp_path):
    """Over restarts: files that come later are read, those read before are not; what fails is reported."""
    from stratarc.streaming.live import drain

    (tmp_path / "in").mkdir()
    at, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    seen = lambda: drain(W.stream_warc(spark, at), "append", None, out)
    (tmp_path / "in" / "a.warc").write_bytes(b"".join(RECORDS))
    (tmp_path / "in" / "no.txt").write_bytes(b"".join(RECORDS))
    assert seen().count() == 7 == seen().count()
    (tmp_path / "in" / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in RECORDS))
    (tmp_path / "in" / "c.warc").write_bytes(b"".join(RECORDS)[:-60])
    with zipfile.ZipFile(tmp_path / "in" / "d.wacz", "w") as z:
        z.writestr("archive/a.warc.gz", b"".join(gzip.compress(r) for r in RECORDS))
    got = {r.file_name: (r.records, r.status) for r in W.ingest_report(seen()).collect()}
    assert got == {"a.warc": (7, "parsed"), "b.warc.gz": (7, "parsed"), "c.warc": (6, "failed"), "d.wacz › archive/a.warc.gz": (7, "parsed")}


def test_listing_feeds_status_and_new_files(spark, tmp_path):
    from stratarc.operators.captures import new_files
    from stratarc.operators.stats import corpus_status

    for n in ("a.warc", "b.warc.gz", "notes.txt"):
        (tmp_path / n).write_bytes(b"x" * 10)
    files = W.accepted(W.listing(spark, f"file://{tmp_path}"))[0]
    status = corpus_status(files, F.lit("2024-01-31")).first()
    assert (status.files, status.bytes) == (2, 20)
    known = files.where("file_name = 'a.warc'").select("file_name", "modified", "size")
    assert [r.file_name for r in new_files(files, known).collect()] == ["b.warc.gz"]
    assert [r.file_name for r in new_files(files, known.withColumn("size", F.col("size") + 1)).orderBy("file_name").collect()] == ["a.warc", "b.warc.gz"]


def test_large_members_are_inflated_in_pieces(tmp_path, monkeypatch):
    p = tmp_path / "one.warc.gz"
    p.write_bytes(gzip.compress(b"".join(RECORDS)) + b"".join(gzip.compress(r) for r in RECORDS))
    whole = list(W.split_members(open(p, "rb"), "t"))
    monkeypatch.setattr(W, "MEMBER", 100)
    monkeypatch.setattr(W, "CHUNK", 64)
    assert len(whole) == 14 and list(W.split_members(open(p, "rb"), "t")) == whole


def test_compressed(spark, tmp_path):
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in RECORDS))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(RECORDS)))
    wire = W.read_warc(spark, str(tmp_path))
    assert {r.file_name: r["count"] for r in wire.groupBy("file_name").count().collect()} == {"members.warc.gz": 7, "one.warc.gz": 7}
    located = [r.payload.gzip for r in wire.where("file_name = 'members.warc.gz' AND payload IS NOT NULL").collect()]
    assert len({g.compressed_offset for g in located}) == len(located) == 2


def test_container_and_broken_file(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "tiny.wacz", "w") as z:
        for n in ("archive/a.warc.gz", "archive/b.warc.gz"):
            z.writestr(n, b"".join(gzip.compress(r) for r in RECORDS))
        z.writestr("pages.jsonl", b"{}")
    (tmp_path / "cut.warc").write_bytes(b"".join(RECORDS)[:-60])
    (tmp_path / "notes.txt").write_text("no")
    report = {r.file_name: r for r in W.ingest_report(W.read_warc(spark, str(tmp_path))).collect()}
    assert report["tiny.wacz › archive/a.warc.gz"].records == 7 and report["tiny.wacz › archive/b.warc.gz"].status == "parsed"
    assert report["cut.warc"].status == "failed" and report["cut.warc"].records == 6 and report["cut.warc"].error_name == "EOFError"
    assert len(report) == 3


def test_input_filter(spark):
    names = spark.createDataFrame([(n,) for n in ("a.warc", "b.WARC.GZ", "c.wacz", "d.wacz.zip", "e.gz", None)], "file_name string")
    ok, rest = W.accepted(names)
    assert ok.count() == 4 and rest.count() == 2


def test_ranges():
    assert W.plan_ranges(100) == [(0, 100)]
    got = W.plan_ranges(1600 << 20)
    assert len(got) == 25 and got[0][0] == 0 and got[-1][1] == 1600 << 20 and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    assert all(z - a >= W.SPLIT_FLOOR for a, z in got)


def test_nothing_to_read(spark, tmp_path):
    assert W.read_warc(spark, str(tmp_path)).where(F.col("type").isNotNull()).count() == 0


class Counting(io.BytesIO):
    """Counts the bytes that are read."""

    got = 0

    def read(self, size=-1):
        data = super().read(size)
        self.got += len(data)
        return data


def test_short_members_and_ranges_are_read_about_once():
    data = b"".join(gzip.compress(record("response", f"http://e.com/{i}", b"x" * 500, OK, i)) for i in range(8000))
    raw = Counting(data)
    assert W._walked(W.Part(raw, 0, len(data)), "gz", 0, len(data)) == len(data)
    assert raw.got < 2 * len(data)
    plain = b"".join(record("response", f"http://e.com/{i}", b"x" * 2000, OK, i) for i in range(2000))
    raw, step = Counting(plain), 100_000
    at = 0
    for start in range(0, len(plain), step):
        part, end = W.Part(raw, 0, len(plain)), min(start + step, len(plain))
        assert W._guess(part, "plain", start, end) == at
        onward = W._walked(part, "plain", at, end)
        assert all(r[-1] is None for r in W.split_records(W.Part(raw, 0, len(plain)), "t", at, end if end < len(plain) else None))
        at = onward
    assert raw.got < 6 * len(plain)  # guessed, walked and parsed


def test_short_pieces_share_tasks(spark, tmp_path):
    (tmp_path / "many.warc").write_bytes(b"".join(record("response", f"http://e.com/{i}", b"x" * 500, OK, i) for i in range(300)))
    wire = W.read_warc(spark, str(tmp_path), splitFrom=1000, splitFloor=1000)
    assert wire.rdd.getNumPartitions() <= 4 and wire.where("_error IS NULL").count() == 300


def test_pieces_of_a_stream(tmp_path):
    for name, data, kind in (("a.warc", b"".join(RECORDS * 40), "plain"), ("a.warc.gz", b"".join(map(gzip.compress, RECORDS * 40)), "gz"), ("b.warc", b"".join(RECORDS * 40)[:-60], "plain")):
        (tmp_path / name).write_bytes(data)
        row = {"uri": str(tmp_path / name), "shown": name, "kind": kind, "inner": None, "base": 0, "size": len(data)}
        cut = list(W._cut(row, 3000, 3000))
        assert len(cut) > 1 and [c[-2] for c in cut] == [0, *(c[-1] for c in cut[:-1])] and cut[-1][-1] == len(data)
        split = W.split_members if kind == "gz" else W.split_records
        got = [r[3] for c in cut for r in split(io.BytesIO(data), name, c[-2], c[-1] if c[-1] < len(data) else None)]
        assert got == offsets(data, kind)
