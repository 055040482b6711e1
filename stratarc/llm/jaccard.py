"""Near copies by exact Jaccard similarity of word shingles.

A text is the set of the upper 40 bits of the XXH64 values of its five-word shingles (one shingle if it has fewer words);
rows are kept in a table in buckets, so that no text moves again, and whole sets are made only for texts of pairs that
are left to compare.  Two texts link at a similarity of 0.8 or more; such sets share one of the first n - ceil(0.8 n) + 1 values of each in any one order of all
values (prefix filter), so that no link is missed.  The order puts values that a sample of texts has often last: it
decides only how many pairs must be looked at, not which link.

Pairs are made in two rounds, both verified on whole sets, after a sketch (parities of values per bit, about a bit for
each value, which differ in no more bits than the sets in values) has ruled out most of the others.  First each text meets
the text that BK-trees over SimHash fingerprints of the same shingles join it to (op2's, ``RADIUS`` bits), and one text per
shared value and size class; the components of these links hold large groups of copies together.  Then texts of different
components meet under the values that can be the first common one of a link: the value at ``pos`` of n serves partners of
(5 n - 9 pos) / 4 values at most.  Pairs inside one component are never made, so a group of g copies costs g pairs, not
g * g; nor are those of texts so far apart that no link has the value first.

Defined cases: null, empty and wordless texts are no copies of anything; letters A-Z and white space count as in simhash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarc.llm.common import free_name, grow, lean, saved, saved_by, shrink
from stratarc.llm.simhash import SEED, components, linked, majority

WORDS = 5
#: One text in so many gives the order; at most so many values are put last.
SAMPLED, LAST = 16, 100_000
#: Bits of the smallest sketch.
SKETCH = 512
#: Differing bits of fingerprints at which texts are compared.
RADIUS = 4


def _digests(text: str | None) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    import xxhash

    parts = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    n = max(1, len(parts) - WORDS + 1) if parts else 0
    return np.fromiter((digest(b" ".join(parts[i : i + WORDS]), SEED) for i in range(n)), np.uint64, n)


def _distinct(digests: np.ndarray) -> np.ndarray:
    return np.unique(digests >> np.uint64(24)).view(np.int64)


def shingles(text: str | None) -> np.ndarray:
    """Distinct values of 40 bits, ascending."""
    return _distinct(_digests(text))


def _order(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Values that are frequent in the sample, ascending, and their ranks from 1, the most frequent last."""

    def run(batches):
        for b in batches:
            for text in b.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py()))], names=["token"])

    some = texts.select("node", "text").where(F.pmod(F.xxhash64("node"), F.lit(SAMPLED)) == 0).mapInArrow(lean(run), "token long")
    often = [r.token for r in some.groupBy("token").count().where("count > 2").orderBy(F.desc("count"), "token").limit(LAST).collect()]
    values = np.array(often, np.int64)
    by = np.argsort(values)
    return values[by], (len(often) - by).astype(np.int64)


def _prefix(values: np.ndarray, order: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """The prefix, in order, of a set of n values, all of which or those of its prefix are given."""
    often, ranks = order
    rank = np.zeros(len(values), np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, values), len(often) - 1)
        rank = np.where(often[at] == values, ranks[at], 0)
    return values[np.lexsort((values, rank))[: n - (4 * n + 4) // 5 + 1 if n else 0]]


def _sketch(values: np.ndarray) -> bytes:
    bits = max(SKETCH, 1 << len(values).bit_length() - 1) if len(values) else SKETCH
    return np.packbits((np.bincount(values & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _differ(p: bytes, q: bytes) -> int:
    """Bits that differ, the longer sketch folded to the length of the shorter."""
    p, q = sorted((np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)), key=len)
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def _marks(texts: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row of (node, id, text): node, id, the set's size n, digest, fingerprint and sketch, and its prefix's values; in buckets by node."""
    import hashlib

    sent = texts.sparkSession.sparkContext.broadcast(order)  # at most 2 * LAST numbers
    schema = f"node long, id {texts.schema['id'].dataType.simpleString()}, n int, fp long, digest binary, sketch binary, prefix binary"

    def mark(digests: np.ndarray):
        values = _distinct(digests)
        n = len(values)
        return n, majority(digests), hashlib.blake2b(values.tobytes(), digest_size=16).digest(), _sketch(values), _packed(np.sort(_prefix(values, sent.value, n)))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                n, fp, *rest = zip(*(mark(_digests(t)) for t in part.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), *(pa.array(r, pa.binary()) for r in rest)], names=["node", "id", "n", "fp", "digest", "sketch", "prefix"])

    return saved_by(texts.mapInArrow(lean(run), schema), "node", "marks")


def _prefixes(nodes: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(node, n, pos, token): the prefix of each set in the order of all values."""
    sent = nodes.sparkSession.sparkContext.broadcast(order)  # at most 2 * LAST numbers

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                found = [_prefix(_values(s), sent.value, n) for n, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                size = np.array([len(f) for f in found], np.int64)
                row = np.repeat(np.arange(len(found)), size)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(pos, pa.int32()), pa.array(np.concatenate(found), pa.int64())], names=["node", "n", "pos", "token"])

    return nodes.select("node", "n", "prefix").mapInArrow(lean(run), "node long, n int, pos int, token long")


def _packed(values: np.ndarray) -> bytes:
    """The values as compressed steps."""
    return shrink(np.diff(values, prepend=0).view(np.uint8).reshape(-1, 8)[:, :5].T)


def _values(data: bytes) -> np.ndarray:
    planes = grow(data, np.uint8)[0].reshape(5, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :5] = planes.T
    return np.cumsum(steps.view(np.int64).ravel())


#: Whether the rest of two sets after a shared value, and their sizes, still allow 0.8.
POSSIBLE = "5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n) AND 9 * (least(x.n - x.pos, y.n - y.pos) + least(x.pos, y.pos)) >= 4 * (x.n + y.n)"


def _verified(pairs: DataFrame, slim: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets have a similarity of 0.8 at least."""

    def close(batches):
        for batch in batches:
            na, nb, p, q = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = [9 * _differ(*x[2:]) <= x[0] + x[1] for x in zip(na, nb, p, q)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def whole(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_packed(shingles(t)) for t in part.column(1).to_pylist()], pa.binary())], names=["node", "tokens"])

    def enough(batches):
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = _values(p), _values(q)
                keep.append(9 * len(np.intersect1d(p, q, assume_unique=True)) >= 4 * (len(p) + len(q)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda node, size, sketch: slim.select(F.col("node").alias(node), F.col("n").alias(size), F.col("sketch").alias(sketch))
    both = pairs.join(side("a", "na", "p"), "a").join(side("b", "nb", "q"), "b")
    pairs = saved(both.select("a", "b", "na", "nb", "p", "q").mapInArrow(lean(close), "a long, b long"), "pairs")
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    # a plain table: a join with the texts that many others meet can be split
    sets = saved(texts.join(asked, "node", "left_semi").select("node", "text").mapInArrow(lean(whole), "node long, tokens binary"), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("p")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("q")), "b")
    return both.select("a", "b", "p", "q").mapInArrow(lean(enough), "a long, b long")


def _alike(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes to be compared, since BK-trees join their fingerprints: one pair for each node and each star."""
    first = saved(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("k")), "fingerprints")
    equal = nodes.join(first.where("k > 1"), "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    named = lambda fp, node: first.select(F.col("fp").alias(fp), F.col("first").alias(node))
    stars = linked(first.select("fp"), RADIUS).distinct().withColumnsRenamed({"a": "fa", "b": "fb"})
    return equal.unionByName(stars.join(named("fa", "a"), "fa").join(named("fb", "b"), "fb").select("a", "b"))


def _meeting(named: DataFrame) -> DataFrame:
    """(token, ga, gb): groups that can have a link whose first common value is the token, of rows (token, group, n, far)."""
    groups = named.groupBy("token", "group").agg(F.min("n").alias("least"), F.max("far").alias("far"))
    met = groups.alias("x").join(groups.alias("y"), "token").where("x.group < y.group AND x.least <= y.far AND y.least <= x.far")
    return met.select("token", F.col("x.group").alias("ga"), F.col("y.group").alias("gb"))


def copies(nodes: DataFrame, order: tuple[np.ndarray, np.ndarray], texts: DataFrame) -> DataFrame:
    """(a, b): every ``node`` of a component of links but the smallest, with that one; ``node`` is unique; order is that of _order(), texts has the text of each node."""
    slim = saved(nodes.select("node", "n", "fp", "sketch"), "sketches")
    tokens = _prefixes(nodes, order)
    twice = tokens.groupBy("token").count().where("count > 1").select("token")
    tokens = saved(tokens.join(twice, "token", "left_semi").withColumn("size", F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int")).select("node", "n", "pos", "token", "size"), "shared")

    heads = tokens.groupBy("token", "size").agg(F.min(F.struct("node", "n", "pos")).alias("y"), F.count("*").alias("k")).where("k > 1").select("token", "size", "y.*")
    met = tokens.alias("x").join(heads.alias("y"), ["token", "size"]).where("x.node <> y.node").where(POSSIBLE).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    first = met.unionByName(_alike(slim.select("node", "fp"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    near = saved(_verified(first, slim, texts), "links")
    group = components(near)

    named = tokens.join(group.select(F.col("a").alias("node"), F.col("b").alias("group")), "node", "left").withColumn("group", F.coalesce("group", "node"))
    named = saved(named, "named")
    open_ = named.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("token")
    named = saved(named.join(open_, "token", "left_semi"), "open")
    named = named.withColumn("far", F.floor((5 * F.col("n") - 9 * F.col("pos")) / 4))
    x = _meeting(named).join(named.select("token", F.col("group").alias("ga"), F.struct("node", "n", "far").alias("x")), ["token", "ga"])
    second = x.join(named.select("token", F.col("group").alias("gb"), F.struct("node", "n", "far").alias("y")), ["token", "gb"]).where("x.n <= y.far AND y.n <= x.far")
    far = _verified(second.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), slim, texts)
    return components(group.unionByName(far))


def without_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those that an earlier one (smaller id, nulls last; then row) is linked to, over any number of links."""
    row = free_name(docs, "__row")
    rows = saved_by(docs.withColumn(row, F.monotonically_increasing_id()), row, "rows")
    texts = rows.select(F.col(row).alias("node"), F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"))
    order = _order(texts)
    marks = _marks(texts, order)
    rank = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("node"))
    same = marks.where("n > 0").groupBy("digest").agg(F.min(rank).alias("r"))
    first = saved(same.select("r.node", "r.id"), "nodes")
    nodes = marks.join(first.select("node"), "node", "left_semi")
    rooted = first.join(copies(nodes, order, texts).select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = rooted.groupBy("root").agg(F.min(rank).alias("r")).select("r.node").unionByName(marks.where("n = 0").select("node"))
    return rows.join(kept.withColumnRenamed("node", row), row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
