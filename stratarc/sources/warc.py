"""WARC, WARC.GZ and WACZ files as DataFrames of records.

``read_warc(spark, path)`` gives one row per record and one error row for a file that breaks off.  It is three jobs over
any file system that both Spark and Arrow reach (files are listed by Spark and opened by Arrow):

1. *Archives* (``archives``).  The listing is a DataFrame; containers are opened in tasks, and each inner archive that is
   stored (not deflated) is a range of bytes of its container, like a file of its own.
2. *Pieces* (``pieces``).  Archives of ``splitFrom`` bytes or more are cut into ranges of at least ``splitFloor`` bytes.
   All ranges are walked at once: each looks for a first start that leads on to another one, and goes from start to
   start (by the lengths in record headers, or by inflating gzip members) to the first one behind its end.  What looks
   like a start may be part of a body, say of an embedded archive.  So the ranges of an archive are then chained: the
   first starts at 0, and each next one must start where the one before it ended; a range that guessed otherwise is
   walked again from there.  Every record so belongs to the range in which it starts, whatever bodies hold.
3. *Records*.  Pieces are parsed in tasks of some ``SPLIT_FLOOR`` bytes at least, so that short pieces do not cost a task each.

Bytes are read in steps that grow (``STEP`` to ``CHUNK``), so that a short range or member reads little beyond its end.

A member of more than ``MEMBER`` bytes is inflated piece by piece.  Inner archives that are deflated are one piece.
Options: ``splitFloor``, ``splitFrom`` (bytes) and ``names`` (a pattern for other file names).
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratarc.operators.stored import stored

SPLIT_FROM, SPLIT_FLOOR = 128 << 20, 64 << 20
STEP, CHUNK = 1 << 16, 1 << 20
#: Bytes of a member that is held whole.
MEMBER = 64 << 20
MAGIC = b"\x1f\x8b\x08"
START = re.compile(rb"\r\n\r\n(?=WARC/1\.[0-9]\r\n)")
ACCEPTED = r"(?i)\.(warc|warc\.gz|wacz|wacz\.zip)$"
SCHEMA = (
    "file_name string, type string, url string, offset bigint, warc map<string,string>, http map<string,string>, version string, status int, status_text string, "
    "payload struct<offset:bigint,size:bigint,chunks:array<bigint>,full_size:bigint,digest:string,gzip:struct<compressed_offset:bigint,compressed_length:bigint,payload_offset:bigint>>, "
    "_error struct<stage:string,name:string,message:string,last_offset:bigint>"
)


def accepted(listing: DataFrame, name: str = "file_name") -> tuple[DataFrame, DataFrame]:
    """(archives, the rest) of a listing of names."""
    ok = F.coalesce(F.col(name).rlike(ACCEPTED), F.lit(False))
    return listing.where(ok), listing.where(~ok)


def plan_ranges(size: int, floor: int = SPLIT_FLOOR, from_: int = SPLIT_FROM) -> list[tuple[int, int]]:
    """Abutting byte ranges of a plain file."""
    n = size // floor if size >= from_ else 1
    edges = [size * i // n for i in range(n + 1)]
    return list(zip(edges[:-1], edges[1:])) or [(0, size)]


def opened(uri: str):
    """A seekable stream of a listed file."""
    from pyarrow import fs

    if uri.startswith(("file:", "/")):
        return fs.LocalFileSystem().open_input_file("/" + uri.removeprefix("file:").lstrip("/"))
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def created(uri: str):
    """A stream that writes a file of any such file system."""
    from pyarrow import fs

    if uri.startswith(("file:", "/")):
        return fs.LocalFileSystem().open_output_stream("/" + uri.removeprefix("file:").lstrip("/"), compression=None)
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path, compression=None)


class Part:
    """The bytes [base, base + size) of a stream as a stream."""

    def __init__(self, stream, base: int, size: int):
        self.stream, self.base, self.size, self.at = stream, base, size, 0
        self.block, self.begin = b"", 0  # what was read last for short reads, and where it begins

    def seek(self, at: int) -> int:
        self.at = at
        return at

    def read(self, size: int) -> bytes:
        size = max(0, min(size, self.size - self.at))
        if not size:
            return b""
        if size < STEP:
            if not self.begin <= self.at <= self.begin + len(self.block) - size:
                self.stream.seek(self.base + self.at)
                self.begin, self.block = self.at, self.stream.read(min(STEP, self.size - self.at))
            data = self.block[self.at - self.begin : self.at - self.begin + size]
        else:
            self.stream.seek(self.base + self.at)
            data = self.stream.read(size)
        self.at += len(data)
        return data


class Ahead:
    """A stream read from a place on, some bytes ahead; of what was taken last, bytes can be put back."""

    def __init__(self, stream, at: int | None = None):
        if at is not None:
            stream.seek(at)
        self.stream, self.step, self.buffer, self.pos = stream, STEP, b"", 0

    def take(self, size: int) -> memoryview:
        if self.pos == len(self.buffer):
            self.buffer, self.pos = self.stream.read(self.step), 0
            self.step = min(2 * self.step, CHUNK)
        out = memoryview(self.buffer)[self.pos : self.pos + size]
        self.pos += len(out)
        return out

    def back(self, size: int) -> None:
        self.pos -= size


def _headers(block: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = block.decode("utf-8", "replace").split("\r\n")
    bag: dict[str, str] = {}
    for line in lines:
        name, sep, value = line.partition(":")
        if sep and name not in bag:
            bag[name.strip()] = value.strip()
    return first, bag


def _get(bag: dict[str, str], name: str) -> str | None:
    return next((v for k, v in bag.items() if k.lower() == name), None)


CHUNK_HEAD = re.compile(rb"([0-9a-fA-F]+)[^\r\n]*\r\n")


def _chunks(body: bytes) -> list[int] | None:
    """Sizes of a chunked transfer."""
    sizes, at = [], 0
    while at < len(body):
        m = CHUNK_HEAD.match(body, at)
        if not m:
            return sizes or None
        n = int(m[1], 16)
        if not n:
            return sizes
        sizes.append(n)
        at = m.end() + n + 2
    return sizes


def _row(name: str, offset: int, bag: dict[str, str], head: int, body: bytes, gz: tuple[int, int] | None) -> tuple:
    kind = _get(bag, "warc-type")
    http, version, status, text, at = None, None, None, None, 0
    if (_get(bag, "content-type") or "").startswith("application/http") and b"\r\n" in body:
        at = body.find(b"\r\n\r\n") + 4
        at = at if at > 3 else len(body)
        first, http = _headers(body[:at].rstrip(b"\r\n"))
        if m := re.match(r"(HTTP/\S+) (\d{3})(?: (.*))?$", first):
            version, status, text = m[1], int(m[2]), m[3]
    size = len(body) - at
    payload = None
    if size > 0 and kind in ("response", "resource"):
        chunks = _chunks(body[at:]) if http and (_get(http, "transfer-encoding") or "").lower() == "chunked" else None
        member = (gz[0], gz[1], head + at) if gz else None
        payload = (offset + head + at if not gz else gz[0], size, chunks, sum(chunks) if chunks else size, _get(bag, "warc-payload-digest"), member)
    return (name, kind, _get(bag, "warc-target-uri"), offset, bag, http, version, status, text, payload, None)


def _next_record(stream, at: int) -> int | None:
    """Where the record behind the one at ``at`` starts (the end of the stream, if there is none); None if none can be read there."""
    stream.seek(at)
    head = b""
    while (k := head.find(b"\r\n\r\n")) < 0:
        more = stream.read(8192)
        if not more:
            return None
        head += more
    first, bag = _headers(head[:k])
    length = _get(bag, "content-length") or "0"
    if not first.startswith("WARC/") or not length.isascii() or not length.isdigit():
        return None
    at += k + 4 + int(length)
    if int(length) and (stream.seek(at - 1) is None or not stream.read(1)):
        return None  # the stream ends before the record does
    stream.seek(at)
    while (breaks := stream.read(256)).startswith(b"\r\n"):
        size = len(re.match(rb"(?:\r\n)*", breaks)[0])
        at += size
        if size < len(breaks) - 1:
            break
        stream.seek(at)
    return at


def _next_member(ahead: Ahead, at: int, like: bytes = b"") -> int | None:
    """Where the gzip member behind the one at ``at`` starts, where ``ahead`` is; None if there is none, or its bytes do not begin with ``like``."""
    member, first = _Member(ahead), b""
    try:
        while out := member.read(CHUNK):
            if len(first) < len(like):
                first += out[: len(like)]
                if not first.startswith(like[: len(first)]):
                    return None
    except (EOFError, zlib.error):
        return None
    return at + member.used if first[: len(like)] == like else None


def _guess(stream, kind: str, start: int, end: int) -> int | None:
    """The first place in [start, end) that looks like a start and leads on to another one, or to the end."""
    if not start:
        return 0
    back = 0 if kind == "gz" else 4  # of a record, the break before it is looked for
    at, buffer = max(0, start - back), b""
    pattern = re.compile(re.escape(MAGIC)) if kind == "gz" else START
    while at < end:
        stream.seek(at)
        buffer = stream.read(min(CHUNK, end - at + 16))
        if not buffer:
            return None
        for m in pattern.finditer(buffer):
            place = at + (m.start() if kind == "gz" else m.end())
            if place >= end:
                return None
            onward = _next_member(Ahead(stream, place), place, b"WARC/") if kind == "gz" else _next_record(stream, place)
            if onward is None:
                continue
            stream.seek(onward)
            if (follow := stream.read(8)) and not follow.startswith(MAGIC if kind == "gz" else b"WARC/1."):
                continue
            return place
        at += max(1, len(buffer) - 16)
    return None


def _walked(stream, kind: str, at: int, end: int) -> int | None:
    """The first start at or behind ``end``, going from start to start; None if that breaks off."""
    source = Ahead(stream, at) if kind == "gz" and at is not None else stream
    step = _next_member if kind == "gz" else _next_record
    while at is not None and at < end:
        at = step(source, at)
    return at


def split_records(stream, name: str, start: int = 0, end: int | None = None) -> Iterator[tuple]:
    """Rows of the records that start in [start, end) of a plain stream, of which one starts at ``start``."""
    last = None
    try:
        if start:
            stream.seek(start)
        base, buffer, pos = start, b"", 0  # buffer begins at ``base``; the next record at base + pos

        def fill(size: int) -> bool:
            """At least ``size`` bytes behind pos; what was read is dropped once for each read."""
            nonlocal base, buffer, pos
            while len(buffer) - pos < size:
                left = CHUNK if end is None else end - base - len(buffer)
                more = stream.read(max(min(CHUNK, max(STEP, left)), size - (len(buffer) - pos)))
                if not more:
                    return False
                base, buffer, pos = base + pos, buffer[pos:] + more, 0
            return True

        while end is None or base + pos < end:
            while (k := buffer.find(b"\r\n\r\n", pos)) < 0:
                if not fill(len(buffer) - pos + 1):
                    if buffer[pos:].strip():
                        raise EOFError("the file ends inside a record header")
                    return
            head = k + 4 - pos
            first, bag = _headers(buffer[pos:k])
            if not first.startswith("WARC/"):
                raise ValueError("no record starts here")
            length = int(_get(bag, "content-length") or 0)
            fill(head + length + 4)
            if len(buffer) - pos < head + length:
                raise EOFError("the file ends inside a record")
            yield _row(name, base + pos, bag, head, buffer[pos + head : pos + head + length], None)
            last = base + pos
            pos += head + length
            while fill(2) and buffer[pos : pos + 2] == b"\r\n":
                pos += 2
    except Exception as e:  # a file that fails keeps what was read before
        yield (name, *([None] * 9), ("parse", type(e).__name__, str(e), last))


class _Member:
    """One gzip member, read as a plain stream; ``used`` counts its compressed bytes, and what is behind it is put back."""

    def __init__(self, ahead: Ahead):
        self.ahead, self.used, self.step = ahead, 0, 1 << 12
        self.inflater = zlib.decompressobj(zlib.MAX_WBITS | 16)

    def read(self, size: int) -> bytes:
        while not self.inflater.eof:
            data = self.inflater.unconsumed_tail
            if not data:
                data, self.step = self.ahead.take(self.step), min(2 * self.step, STEP)
                self.used += len(data)
            out = self.inflater.decompress(data, size)
            if not data and not out:
                raise EOFError("the file ends inside a member")
            if self.inflater.eof:
                self.used -= len(self.inflater.unused_data)
                self.ahead.back(len(self.inflater.unused_data))
            if out:
                return out
        return b""


def split_members(stream, name: str, start: int = 0, end: int | None = None) -> Iterator[tuple]:
    """Rows of the gzip members that start in [start, end) of a stream, of which one starts at ``start``; usually one per record.

    A member with more than ``MEMBER`` bytes is inflated twice, first for its length, so that it is never held whole.
    """
    at, last = start, None
    try:
        ahead = Ahead(stream, start or None)
        while end is None or at < end:
            if not len(begin := ahead.take(1)):
                break
            ahead.back(len(begin))
            member, parts, size = _Member(ahead), [], 0
            while size <= MEMBER and (out := member.read(CHUNK)):
                parts.append(out)
                size += len(out)
            if size <= MEMBER:
                plain = io.BytesIO(b"".join(parts))
            else:
                parts.clear()
                while member.read(CHUNK):
                    pass
                plain = _Member(Ahead(stream, at))
            used = member.used
            for row in split_records(plain, name):
                if row[-1] is not None:
                    raise EOFError(row[-1][2]) if row[-1][1] == "EOFError" else ValueError(row[-1][2])
                payload = row[9] and (at, *row[9][1:5], (at, used, row[9][0]))
                yield (*row[:3], at, *row[4:9], payload, None)
                last = at
            at += used
            if size > MEMBER:
                ahead = Ahead(stream, at)
    except Exception as e:
        yield (name, *([None] * 9), ("parse", type(e).__name__, str(e), last))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(uri, file_name, modified, size) of all files under a path, of any file system that Spark lists; no content is read."""
    return _listed(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def _listed(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("uri"), F.regexp_extract("path", "[^/]+$", 0).alias("file_name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


ARCHIVE = "uri string, shown string, kind string, inner string, base long, size long"
GZ, ZIP, INNER = re.compile(r"(?i)\.gz$"), re.compile(r"(?i)\.(wacz|zip)$"), re.compile(r"(?i)\.warc(\.gz)?$")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _rows_of(batches, run, schema: pa.Schema, most: int = 500) -> Iterator[pa.RecordBatch]:
    """run(row) for each row, its tuples in batches of bounded size."""
    held, size = [], 0
    for b in batches:
        for row in b.to_pylist():
            for out in run(row):
                held.append(out)
                if len(held) >= most:
                    yield _batch(held, schema)
                    held = []
    if held:
        yield _batch(held, schema)


def _over(df: DataFrame, run, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    typed = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(typed)
    return df.mapInArrow(lambda batches: _rows_of(batches, run, arrow), typed)


def _inner(row: dict) -> Iterator[tuple]:
    """The inner archives of a container; it is kept as one archive if there are none."""
    uri, shown, size = row["uri"], row["file_name"], row["size"]
    try:
        with opened(uri) as f, zipfile.ZipFile(f) as z:
            inner = [i for i in z.infolist() if INNER.search(i.filename)]
            for i in inner:
                kind, base = "gz" if GZ.search(i.filename) else "plain", 0
                if i.compress_type == zipfile.ZIP_STORED:
                    f.seek(i.header_offset)
                    local = f.read(30)
                    base = i.header_offset + 30 + int.from_bytes(local[26:28], "little") + int.from_bytes(local[28:30], "little")
                yield uri, f"{shown} › {i.filename}", kind, i.filename if not base else None, base, i.file_size
    except (OSError, zipfile.BadZipFile):
        inner = []
    if not inner:
        yield uri, shown, "plain", None, 0, size


def archives(files: DataFrame, names: str = ACCEPTED) -> DataFrame:
    """The archives of a listing, those inside containers each (S3); ``inner`` names one that is deflated."""
    files = files.where(F.col("file_name").rlike(names))
    zipped = F.col("file_name").rlike(ZIP.pattern)
    kind = F.when(F.col("file_name").rlike(GZ.pattern), "gz").otherwise("plain")
    plain = files.where(~zipped).select("uri", F.col("file_name").alias("shown"), kind.alias("kind"), F.lit(None).cast("string").alias("inner"), F.lit(0).cast("long").alias("base"), "size")
    held = files.where(zipped)
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return plain.unionByName(_over(held.repartition(parts, "uri"), _inner, ARCHIVE))


RANGE = "start long, end long, first long, next long"


def pieces(found: DataFrame, floor: int = SPLIT_FLOOR, from_: int = SPLIT_FROM) -> DataFrame:
    """The archives' columns with first and end: true starts, one row for each range in which a record or member starts.

    A stored table of one row for each range; no record is kept.
    """
    spark = found.sparkSession
    n = F.when((F.col("size") >= from_) & F.col("inner").isNull(), F.floor(F.col("size") / floor)).otherwise(1).cast("int")
    edge = lambda i: F.floor(F.col("size") * i / F.col("n")).cast("long")
    cut = found.withColumn("n", F.greatest(n, F.lit(1))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("start", edge(F.col("i"))).withColumn("end", edge(F.col("i") + 1))
    names = [f.name for f in T._parse_datatype_string(ARCHIVE)]

    def walk(row: dict):
        own = tuple(row[c] for c in names)
        if row["n"] == 1:
            yield (*own, 0, row["end"], 0, row["size"])
            return
        with opened(row["uri"]) as f:
            part = Part(f, row["base"], row["size"])
            first = _guess(part, row["kind"], row["start"], row["end"])
            yield (*own, row["start"], row["end"], first, None if first is None else _walked(part, row["kind"], first, row["end"]))

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    walked = _over(cut.repartition(parts, "uri", "base", "start"), walk, f"{ARCHIVE}, {RANGE}")

    def chained(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["start"])
        out, at, stream = [], 0, None
        for r in rows:
            if at is None:
                break  # the range before it breaks off: its piece says so
            if at >= r["end"]:
                continue  # one record covers all of this range
            out.append({**r, "first": at})
            if r["first"] == at:
                at = r["next"]
            else:
                stream = stream or opened(r["uri"])
                at = _walked(Part(stream, r["base"], r["size"]), r["kind"], at, r["end"])
        return pa.Table.from_pylist([{k: v for k, v in r.items() if k != "next"} for r in out], schema=pa.schema([f for f in table.schema if f.name != "next"]))

    # an archive's ranges are as many as it has times ``floor`` bytes
    checked = walked.groupBy("uri", "base", "inner").applyInArrow(chained, f"{ARCHIVE}, start long, end long, first long")
    return stored(checked.drop("start"), "pieces")


def _parsed(row: dict) -> Iterator[tuple]:
    split = split_members if row["kind"] == "gz" else split_records
    end = row["end"] if row["end"] < row["size"] else None
    with opened(row["uri"]) as f:
        if row["inner"] is not None:
            with zipfile.ZipFile(f) as z, z.open(row["inner"]) as inside:
                yield from _wire(split(inside, row["shown"]))
        else:
            yield from _wire(split(Part(f, row["base"], row["size"]), row["shown"], row["first"], end))


def _wire(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows as Arrow takes them: maps as pairs, structs by name."""
    located = ("compressed_offset", "compressed_length", "payload_offset")
    fields = ("offset", "size", "chunks", "full_size", "digest", "gzip")
    failed = ("stage", "name", "message", "last_offset")
    for name, kind, url, offset, warc, http, version, status, text, payload, error in rows:
        if payload is not None:
            payload = dict(zip(fields, (*payload[:5], payload[5] and dict(zip(located, payload[5])))))
        pairs = lambda bag: None if bag is None else list(bag.items())
        yield name, kind, url, offset, pairs(warc), pairs(http), version, status, text, payload, error and dict(zip(failed, error))


def read_warc(spark: SparkSession, path: str, splitFloor: int = SPLIT_FLOOR, splitFrom: int = SPLIT_FROM, names: str = ACCEPTED) -> DataFrame:
    found = pieces(archives(listing(spark, path), names), splitFloor, splitFrom)
    return _over(_dealt(found), _parsed, SCHEMA)


def _dealt(found: DataFrame) -> DataFrame:
    """Pieces dealt to tasks: one each, or several if they are so short that there would be more tasks than SPLIT_FLOOR bytes and shuffle partitions ask for."""
    n, size = found.select(F.count("*"), F.coalesce(F.sum(F.col("end") - F.col("first")), F.lit(0))).first()
    most = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SPLIT_FLOOR))
    return found.repartitionByRange(max(n, 1), "uri", "base", "first") if n <= most else found.repartition(most, "uri", "base", "first")


def stream_warc(spark: SparkSession, path: str, names: str = ACCEPTED, files_at_once: int = 100) -> DataFrame:
    """The records of a folder as files arrive (S1, X6): a stream that gives each file's records once, also across restarts.

    Which files were read is the state of Spark's own file source.  A stream cannot chain guessed ranges: each archive is
    walked by one task, which skips bodies by their lengths, and its pieces are parsed in many.  Files must be moved into
    the folder whole.
    """
    kind = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_at_once).load(path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = _over(archives(_listed(files), names), _cut, f"{ARCHIVE}, first long, end long")
    return _over(cut.repartition(parts, "uri", "base", "first"), _parsed, SCHEMA)


def _cut(row: dict, floor: int = SPLIT_FLOOR, from_: int = SPLIT_FROM) -> Iterator[tuple]:
    """The pieces of an archive, walked from its begin."""
    own = tuple(row[f.partition(" ")[0]] for f in ARCHIVE.split(", "))
    size = row["size"]
    if row["inner"] is not None or size < from_:
        yield (*own, 0, size)
        return
    with opened(row["uri"]) as f:
        part, at = Part(f, row["base"], size), 0
        while at is not None and at < size:
            onward = _walked(part, row["kind"], at, min(at + floor, size))
            yield (*own, at, size if onward is None else onward)  # where the walk breaks off, the piece says so
            at = onward


def members(found: DataFrame) -> DataFrame:
    """The gzip members of pieces (S2): uri, shown, offset and length of each, and where its record's payload starts inside (null without one)."""

    def run(row: dict):
        with opened(row["uri"]) as f:
            part = Part(f, row["base"], row["size"])
            at, payload = None, None
            for r in split_members(part, row["shown"], row["first"], row["end"] if row["end"] < row["size"] else None):
                if r[10] is not None:
                    break
                if r[3] != at:
                    if at is not None:
                        yield row["uri"], row["shown"], at, r[3] - at, payload
                    at, payload = r[3], None
                if payload is None and r[9]:
                    payload = r[9][5][2]
            if at is not None and (end := _next_member(Ahead(part, at), at)) is not None:
                yield row["uri"], row["shown"], at, end - at, payload

    return _over(found.where("kind = 'gz' AND inner IS NULL"), run, "uri string, shown string, offset long, length long, payload_offset long")


def records(wire: DataFrame) -> DataFrame:
    return wire.where("_error IS NULL").drop("_error")


def ingest_report(wire: DataFrame) -> DataFrame:
    """Per file: status, records, responses, last good offset and the failure."""
    return wire.groupBy("file_name").agg(
        F.when(F.count("_error") > 0, "failed").otherwise("parsed").alias("status"),
        F.count_if(F.col("_error").isNull()).alias("records"),
        F.count_if(F.col("_error").isNull() & (F.col("type") == "response")).alias("responses"),
        F.max("offset").alias("last_offset"),
        F.max("_error.stage").alias("stage"),
        F.max("_error.name").alias("error_name"),
        F.max("_error.message").alias("message"),
    )
