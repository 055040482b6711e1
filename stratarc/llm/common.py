"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract: space and U+0009..U+000D.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one would lose rows on a cluster, so there is none by default."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return at


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def saved_by(df: DataFrame, key: str, name: str, compression: str = "snappy") -> DataFrame:
    """Like saved(), as a table in buckets by the key: joins on it need no exchange of this side.

    ``compression``: ``uncompressed`` where values are compressed already, since codecs hold whole pages outside the heap.
    """
    spark = df.sparkSession
    label = f"{name}_{uuid.uuid4().hex}"
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", f"{shared_dir(spark)}/{label}").option("compression", compression).format("parquet").saveAsTable(label)
    return spark.table(label)


def in_bytes(text: Column) -> Column:
    """UTF-8 length; null counts as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """Inside, batches for Python have at most so many rows: 10,000 whole texts are tens of MB outside the heap in each task.

    Only for what is written inside; lazy plans take the setting of their own run.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(most, int(before)) if int(before) > 0 else most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hex_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its own columns are called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shrink(*arrays: np.ndarray) -> bytes:
    """The arrays' bytes, compressed; grow() gives them back."""
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return np.array([len(p) for p in parts], "<u4").tobytes() + pa.compress(b"".join(parts), codec="zstd", asbytes=True)


def grow(data, *kinds) -> list[np.ndarray]:
    data = memoryview(data)
    sizes = np.frombuffer(data[: 4 * len(kinds)], "<u4")
    raw = pa.decompress(pa.py_buffer(data[4 * len(kinds) :]), int(sizes.sum()), codec="zstd") if sizes.any() else b""
    ends = np.cumsum(sizes)
    return [np.frombuffer(raw[e - s : e], k) for k, s, e in zip(kinds, sizes.tolist(), ends.tolist())]


def give_back() -> None:
    """Hands memory that is free inside this Python worker to the system: workers live on, with what their largest task took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """A function for mapInArrow that gives free memory back after each batch it has read, and at the end of its task."""

    def each(batches):
        for b in batches:
            yield b
            give_back()

    def wrapped(batches):
        yield from run(each(batches))
        give_back()

    return wrapped


def lean_group(run: Callable) -> Callable:
    """A function for applyInArrow that gives free memory back after each group."""

    def wrapped(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out

    return wrapped


def runs(batches, *keys: str):
    """Tables of consecutive rows with equal (and no null) keys, across the ends of batches."""
    left = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if left is None else pa.concat_tables([left, t]).combine_chunks()
        if not t.num_rows:
            continue
        other = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            c = t.column(k)
            other |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy()
        first = 0
        for end in (np.flatnonzero(other) + 1).tolist():
            yield t.slice(first, end - first)
            first = end
        left = t.slice(first)
    if left is not None:
        yield left


def worker_cached(key, make: Callable):
    """What make() gives, kept by this Python worker for the tasks that follow (only derived, bounded things)."""
    home = sys.modules.setdefault("stratarc_worker_cache", types.ModuleType("stratarc_worker_cache")).__dict__
    if key not in home:
        home[key] = make()
    return home[key]
