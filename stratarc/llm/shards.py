"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by (hash of the text, id, position of the row in the saved key table).  Splitters that cut the order
into runs of equal bytes are found by counting: each round sums the exact bytes between candidate boundaries
(probes) over all partitions, keeps for every splitter the one interval that its target falls into, and puts new
probes there, until the bytes below a probe are within the tolerance.  Only then are rows exchanged, once.

Equal texts have one hash, so that a splitter between hashes keeps them together.  A splitter goes inside a group of
equal texts only where the group is too large for ``group_tolerance``.  Beside the shards' splitters, looser ones cut
each shard into parts, so that no task sorts a whole shard and a group of copies with a third of all rows is dealt
over many tasks.

Defined cases: null text counts as no bytes (size 1) and groups with the empty text; null ids sort first; repeated
rows each get a slot; an empty table gives an empty table; other columns are kept, except ones named like the added.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from stratarc.llm.common import in_bytes, saved

#: Keys are taken as whole numbers below 2^62, so that differences never overflow.
BITS = 62


@dataclass
class Probe:
    """A splitter that is sought: a target in bytes, and the interval of the key it is known to lie in."""

    target: float
    near: float
    group: float
    prefix: tuple[int, ...] = ()
    low: int = 0
    high: int = 1 << BITS
    below: int = 0
    found: tuple[int, int, int] | None = None


def _padded(prefix: tuple[int, ...], at: int) -> tuple[int, int, int]:
    return tuple([*prefix, at, 0, 0][:3])


def find_splitters(keys: DataFrame, key: list[str], size: str, probes: list[Probe], bins: int = 4096) -> list[tuple[int, int, int]]:
    """Rounds of exact counting; what comes to the driver is at most ``bins`` sums for each interval still open."""
    while open_ := [p for p in probes if p.found is None]:
        spans = sorted({(p.prefix, p.low, p.high) for p in open_})
        width = {s: max(1, -(-(s[2] - s[1]) // max(16, bins // len(spans)))) for s in spans}
        where, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, s in enumerate(spans):
            prefix, low, high = s
            at = F.col(key[len(prefix)])
            inside = (at >= low) & (at <= high - 1)
            for name, v in zip(key, prefix):
                inside = inside & (F.col(name) == v)
            where = F.when(inside, i).otherwise(where)
            slot = F.when(inside, F.expr(f"(`{key[len(prefix)]}` - {low}L) div {width[s]}L")).otherwise(slot)
        got = keys.select(where.alias("span"), slot.alias("bin"), size).where("span IS NOT NULL").groupBy("span", "bin").agg(F.sum(size).alias("bytes")).collect()
        sums: dict[tuple, list[tuple[int, int]]] = {s: [] for s in spans}
        for r in got:
            sums[spans[r.span]].append((r.bin, r.bytes))
        for p in open_:
            s, below = (p.prefix, p.low, p.high), p.below
            w = width[s]
            for b, n in sorted(sums[s]):
                low, high = p.low + b * w, min(p.high, p.low + (b + 1) * w)
                if below + n > p.target:
                    edge, error = min(((low, p.target - below), (high, below + n - p.target)), key=lambda x: x[1])
                    last = w == 1
                    if error <= p.near or (last and (error <= p.group or len(p.prefix) == 2)):
                        p.found = _padded(p.prefix, edge)
                    elif last:
                        p.prefix, p.low, p.high, p.below = (*p.prefix, low), 0, 1 << BITS, below
                    else:
                        p.low, p.high, p.below = low, high, below
                    break
                below += n
            else:
                p.found = _padded(p.prefix, p.high)
    return sorted(p.found for p in probes)


def _bucket(key: list[str], splitters: list[tuple[int, int, int]]) -> Column:
    """How many splitters are at or below the row's key: a table over the first bits, then the few splitters there."""
    bits = 12
    first = [0] * (1 << bits)
    for s in splitters:
        first[min(s[0] >> (BITS - bits), len(first) - 1)] += 1
    starts, n = [], 0
    for c in first:
        starts.append(n)
        n += c
    row = F.struct(*(F.col(k) for k in key))
    cuts = F.array(*(F.struct(*(F.lit(v).cast("long").alias(k) for k, v in zip(key, s))) for s in splitters))
    at = (F.shiftright(key[0], BITS - bits) + 1).cast("int")
    start, count = F.element_at(F.lit(starts), at), F.element_at(F.lit(first), at)
    return F.when(count == 0, start).otherwise(start + F.size(F.filter(F.slice(cuts, start + 1, count), lambda c: c <= row))).cast("int")


def histogram_shards(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text: str = "text", tolerance: float = 0.0005, group_tolerance: float = 0.01, parts: int | None = None, carry: tuple[str, ...] | None = None) -> DataFrame:
    """Adds ``size``, ``shard`` and ``slot`` (gapless from 0, in key order) to the rows.

    ``tolerance`` and ``group_tolerance`` are shares of one shard's bytes; the second holds where the nearer boundary
    would part equal texts.  ``carry`` (all if not given) are the columns that go along.  ``parts`` (the shuffle partitions if not given) is how many tasks sort.
    """
    key = ["__hash", "__id", "__row"]
    kept = [c for c in carry or docs.columns if c.lower() not in ("size", "shard", "slot")]
    spark = docs.sparkSession
    keyed = saved(
        docs.select(
            *(F.col(f"`{c}`") for c in kept),
            (in_bytes(F.col(f"`{text}`")) + 1).alias("size"),
            F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))), 2).alias(key[0]),
            F.coalesce(F.shiftright(F.col(f"`{id_column}`").cast("long"), 2) + (1 << (BITS - 1)), F.lit(0).cast("long")).alias(key[1]),
            F.monotonically_increasing_id().alias(key[2]),
        ),
        "shard-keys",
    )
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    per = max(1, -(-(parts or int(spark.conf.get("spark.sql.shuffle.partitions"))) // shards))
    share = total / shards
    probes = [
        Probe(share * j / per, *((share * tolerance, share * group_tolerance) if j % per == 0 else (share / per / 2, share / per / 2))) for j in range(1, shards * per)
    ]
    tight = find_splitters(keyed, key, "size", [p for i, p in enumerate(probes, 1) if i % per == 0])
    loose = find_splitters(keyed, key, "size", [p for i, p in enumerate(probes, 1) if i % per])
    cuts = sorted({*tight, *loose})
    repeats = [len([t for t in tight if t == c]) for c in cuts]  # shards left empty by equal splitters
    shard_of, n = [0], 0
    for r in repeats:
        n += r
        shard_of.append(n)
    placed = keyed.withColumn("__part", _bucket(key, cuts) if cuts else F.lit(0))
    counts = {r[0]: r[1] for r in placed.groupBy("__part").count().collect()}
    offset, seen = [], {}
    for i, s in enumerate(shard_of):
        offset.append(seen.get(s, 0))
        seen[s] = offset[-1] + counts.get(i, 0)
    order = Window.partitionBy("__part").orderBy(*key)
    at = F.col("__part") + 1
    return placed.select(
        *(F.col(f"`{c}`") for c in kept),
        "size",
        F.element_at(F.lit(shard_of), at).cast("int").alias("shard"),
        (F.element_at(F.lit(offset).cast("array<long>"), at) + F.row_number().over(order) - 1).alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; rows inside a file are in slot order."""
    sharded.repartition("shard", F.expr("slot div 100000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
