"""Size-aware Jaccard join of word shingles: subsets of small sets, inverted lists of large ones.

A text is the set of the 64-bit values of its distinct five-word shingles.  Two sets of sizes m and n link at a
similarity of 0.8 or more, that is with need(m, n) = ceil(4 (m + n) / 9) common values.

* *Light sets* (up to ``x`` values).  For each two sizes m <= n <= x, both sides list their subsets of need(m, n) values;
  sets with a common subset link, and no others of these sizes do.  Under one subset all sets link to the first smallest,
  so a group of g copies costs g links.  A subset is known by two 64-bit sums, so none has to be carried along.
* *Heavy sets.*  Inverted lists over the values that can be the first common one of a link (prefix filter): of n values in
  one order of all, rare ones first, the value at ``pos`` only serves partners of ``far`` = (5 n - 9 pos) / 4 values at most.
  The lists of heavy sets, and of light ones that are large enough to be their partners, are scanned; pairs are
  compared by sketches, then by whole sets.
* *The boundary x* is that of least cost: subsets that light sets would list against postings and pairs that their lists
  would give, both counted over all sets of up to ``MOST`` values (larger ones have too many subsets).

Lists are scanned in two rounds, so that no group of near copies is paired within.  First every set meets one head of
each list and size class: the one for which the value comes earliest, since what is not edited has no rare values before.
The components of these links hold large groups together; then only sets of different components that share a value meet.

Equal sets are one node.  The order of values comes from a sample of texts and decides only how many pairs are looked at.

Defined cases: null, empty and wordless texts have no shingles and are linked with nothing; shorter texts have one;
A-Z are lower-cased; null ids never name a component that holds another id; repeated rows get a row each; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarc.llm.common import free_name, lean, saved, worker_cached
from stratarc.llm.simhash import SEED, components

WORDS = 5
#: One text in so many gives the order; at most so many values are put last (a bound of what is broadcast).
SAMPLED, LAST = 16, 100_000
#: The largest set that may count as light, and what a candidate pair costs in rows of a list or subsets.
MOST, PAIR = 16, 4
#: Bits of the smallest sketch.
SKETCH = 512
#: So many node numbers may be broadcast to pick texts (8 bytes each); beyond, texts are joined by an exchange.
PICKED = 1_000_000
#: Words whose values a worker keeps; beyond it the store starts anew (it is only a cache).
CACHED = 300_000
STEP = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        got = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return got


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * STEP
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Distinct values, ascending (as signed numbers)."""
    words = worker_cached("shingle words", _Words)
    if len(words) > CACHED:
        words.clear()
    parts = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not parts:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    k = min(WORDS, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = _mixed(h + w[i : len(w) - k + 1 + i])
    return np.unique(h.view(np.int64))


def need(m, n):
    """Common values of sets of m and n values at similarity 0.8."""
    return -(-4 * (m + n) // 9)


def _order(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Values that are frequent in the sample, ascending, and their ranks from 1, the most frequent last."""

    def run(batches):
        for b in batches:
            for text in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py()))], names=["token"])

    some = texts.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(lean(run), "token long")
    often = [r.token for r in some.groupBy("token").count().where("count > 2").orderBy(F.desc("count"), "token").limit(LAST).collect()]
    values = np.array(often, np.int64)
    by = np.argsort(values)
    return values[by], (len(often) - by).astype(np.int64)


def _ordered(values: np.ndarray, order: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """The first k of a set's values in the order of all: rare ones by value, then frequent ones by rank."""
    often, ranks = order
    if not len(often):
        return values[:k]
    at = np.minimum(np.searchsorted(often, values), len(often) - 1)
    rank = np.where(often[at] == values, ranks[at], 0)
    rare = values[rank == 0]
    if len(rare) >= k:
        return rare[:k]
    rest = values[rank > 0][np.argsort(rank[rank > 0])]
    return np.concatenate([rare, rest])[:k]


def prefix_size(n):
    """Values of a set of n that can be the first common one of a link."""
    return n - (4 * n + 4) // 5 + 1 if n else 0


def _sketch(values: np.ndarray) -> bytes:
    """Parities of values by their low bits; two of them differ in no more bits than the sets in values."""
    bits = max(SKETCH, 1 << len(values).bit_length() - 1) if len(values) else SKETCH
    return np.packbits((np.bincount(values & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _differ(p: bytes, q: bytes) -> int:
    """Bits that differ, the longer sketch folded to the length of the shorter."""
    p, q = sorted((np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)), key=len)
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def _marks(texts: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row of (node, id, text): node, id, the set's size n, digest and sketch, and the head of its values in the order of all."""
    sent = texts.sparkSession.sparkContext.broadcast(order)  # at most 2 * LAST numbers
    schema = f"node long, id {texts.schema['id'].dataType.simpleString()}, n int, digest binary, sketch binary, head binary"

    def mark(values: np.ndarray):
        n = len(values)
        head = _ordered(values, sent.value, n if n <= MOST else prefix_size(n))
        return n, hashlib.blake2b(values.tobytes(), digest_size=16).digest(), _sketch(values), head.tobytes()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                n, *rest = zip(*(mark(shingles(t)) for t in part.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int32()), *(pa.array(r, pa.binary()) for r in rest)], names=["node", "id", "n", "digest", "sketch", "head"])

    return saved(texts.select("node", "id", "text").mapInArrow(lean(run), schema), "marks")


def _postings(nodes: DataFrame) -> DataFrame:
    """(node, n, pos, token) of each set's prefix."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                n = part.column(1).to_numpy().astype(np.int64)
                found = [np.frombuffer(h, np.int64)[: prefix_size(k)] for k, h in zip(n.tolist(), part.column(2).to_pylist())]
                size = np.array([len(f) for f in found], np.int64)
                row = np.repeat(np.arange(len(found)), size)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(n[row], pa.int32()), pa.array(pos, pa.int32()), pa.array(np.concatenate(found))], names=["node", "n", "pos", "token"])

    return nodes.select("node", "n", "head").mapInArrow(lean(run), "node long, n int, pos int, token long")


def _partners(n: int, x: int) -> list[int]:
    """Sizes up to x that a set of n values can link to."""
    return [m for m in range(1, x + 1) if 5 * min(m, n) >= 4 * max(m, n)]


def subsets_of(n: int, x: int) -> int:
    """Subsets that a light set of n values lists."""
    return sum(comb(n, need(m, n)) for m in _partners(n, x))


def boundary(sizes: dict[int, int], pairs: dict[tuple[int, int], int]) -> int:
    """The x of least cost, from the number of sets by size, and of pairs under one value by both sizes (lower first)."""

    def cost(x: int) -> float:
        light = sum(k * subsets_of(n, x) for n, k in sizes.items() if n <= x)
        lists = sum(k * prefix_size(n) for n, k in sizes.items() if 5 * n >= 4 * (x + 1))
        return light + lists + PAIR * sum(k for (_, n), k in pairs.items() if n > x)

    return min(range(MOST + 1), key=cost)


def _boundary(nodes: DataFrame) -> int:
    """Counts over all sets of up to MOST values: at most MOST * MOST rows come to the driver, however many sets there are."""
    small = nodes.where(F.col("n") <= MOST)
    sizes = {r.n: r["count"] for r in small.groupBy("n").count().collect()}
    listed = saved(_postings(small).groupBy("token", "n").count().withColumnRenamed("count", "k"), "listed")
    x, y = listed.alias("x"), listed.alias("y")
    met = x.join(y, "token").where("x.n <= y.n AND 5 * x.n >= 4 * y.n")  # at most MOST sizes for each value
    pairs = met.groupBy(F.col("x.n").alias("m"), F.col("y.n").alias("n")).agg(F.sum(F.expr("CASE WHEN x.n = y.n THEN x.k * (x.k - 1) / 2 ELSE x.k * y.k END")).alias("k"))
    return boundary(sizes, {(r.m, r.n): r.k for r in pairs.collect()})


def _light(nodes: DataFrame, x: int) -> DataFrame:
    """(a, b): links among sets of up to x values, as stars under each subset."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            of, heads = b.column(1).to_numpy(), b.column(2).to_pylist()
            for n in sorted(set(of.tolist())):
                rows = np.flatnonzero(of == n)
                first = np.stack([np.frombuffer(heads[i], np.uint64) for i in rows.tolist()])
                second = _mixed(first + STEP)
                for m in _partners(n, x):
                    gone = np.array(list(combinations(range(n), n - need(m, n))), np.int64).reshape(comb(n, need(m, n)), -1)
                    for at in range(0, len(rows), 256):  # 256 sets at a time
                        some = slice(at, at + 256)
                        sums = [(v[some].sum(axis=1, keepdims=True) - v[some][:, gone].sum(axis=2)).ravel().view(np.int64) for v in (first, second)]
                        node = b.column(0).take(pa.array(np.repeat(rows[some], len(gone))))
                        k = len(node)
                        yield pa.RecordBatch.from_arrays([node, *(pa.array(np.full(k, v, np.int32)) for v in (n, min(m, n), max(m, n))), *map(pa.array, sums)], names=["node", "n", "lo", "hi", "s", "t"])

    key = ["lo", "hi", "s", "t"]
    listed = nodes.where((F.col("n") > 0) & (F.col("n") <= x)).select("node", "n", "head").mapInArrow(lean(run), "node long, n int, lo int, hi int, s long, t long")
    # under a subset without a set of the lower size nothing links: the others have a key of their own
    first = listed.groupBy(*key).agg(F.min(F.struct("n", "node")).alias("y"), F.count("*").alias("k")).where("k > 1 AND y.n = lo").select(*key, F.col("y.node").alias("b"))
    return saved(listed.join(first, key).where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "light")


def _whole(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, tokens): whole sets of the nodes asked for."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["node", "tokens"])

    asked = saved(asked, "asked")
    few = asked.count() <= PICKED
    return saved(texts.select("node", "text").join(F.broadcast(asked) if few else asked, "node", "left_semi").mapInArrow(lean(run), "node long, tokens binary"), "sets")


def _verified(pairs: DataFrame, slim: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets have a similarity of 0.8 at least."""

    def close(batches):
        for batch in batches:
            na, nb, p, q = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = [9 * _differ(*x[2:]) <= x[0] + x[1] for x in zip(na, nb, p, q)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def enough(batches):
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(x.as_buffer(), np.int64) for x in (p, q))
                keep.append(len(np.intersect1d(p, q, assume_unique=True)) >= need(len(p), len(q)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda node, size, sketch: slim.select(F.col("node").alias(node), F.col("n").alias(size), F.col("sketch").alias(sketch))
    both = pairs.join(side("a", "na", "p"), "a").join(side("b", "nb", "q"), "b")
    pairs = saved(both.select("a", "b", "na", "nb", "p", "q").mapInArrow(lean(close), "a long, b long"), "pairs")
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _whole(texts, asked)  # a plain table: a join with a set that many others meet can be split
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("p")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("q")), "b")
    return both.select("a", "b", "p", "q").mapInArrow(lean(enough), "a long, b long")


def _heavy(nodes: DataFrame, x: int, light: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): components of the light links and of links with a set of more than x values."""
    slim = saved(nodes.select("node", "n", "sketch"), "sketches")
    listed = _postings(nodes.where(5 * F.col("n") >= 4 * (x + 1)))
    twice = listed.groupBy("token").count().where("count > 1").select("token")
    far = F.floor((5 * F.col("n") - 9 * F.col("pos")) / 4).cast("int")
    listed = saved(listed.join(twice, "token", "left_semi").select("token", "node", "n", "pos", far.alias("far")), "lists")

    # size classes of two grids, so that sizes that lie close are together in one of them
    grid = F.log("n") / F.log(F.lit(1.25))
    classes = F.explode(F.array(F.floor(grid).cast("int") * 2, F.floor(grid + 0.5).cast("int") * 2 + 1)).alias("size")
    dealt = listed.select("token", "node", "n", "pos", "far", classes)
    heads = dealt.groupBy("token", "size").agg(F.min(F.struct((F.col("pos") / F.col("n")).alias("early"), "node", "n", "far")).alias("y"), F.count("*").alias("k")).where("k > 1")
    heads = heads.select("token", "size", F.col("y.node").alias("b"), F.col("y.n").alias("nb"), F.col("y.far").alias("fb"))
    met = dealt.join(heads, ["token", "size"]).where(f"node <> b AND n <= fb AND nb <= far AND greatest(n, nb) > {x}")
    near = _verified(met.select(F.col("node").alias("a"), "b").distinct(), slim, texts)
    group = components(near.unionByName(light))

    named = listed.join(group.select(F.col("a").alias("node"), F.col("b").alias("group")), "node", "left").withColumn("group", F.coalesce("group", "node"))
    named = saved(named, "named")
    open_ = named.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("token")
    named = saved(named.join(open_, "token", "left_semi"), "open")
    groups = named.groupBy("token", "group").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("far").alias("far"))
    p, q = groups.alias("p"), groups.alias("q")
    met = p.join(q, "token").where(f"p.group < q.group AND p.least <= q.far AND q.least <= p.far AND greatest(p.most, q.most) > {x}").select("token", F.col("p.group").alias("ga"), F.col("q.group").alias("gb"))
    one = named.select("token", F.col("group").alias("ga"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("far").alias("fa"))
    two = named.select("token", F.col("group").alias("gb"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("far").alias("fb"))
    second = met.join(one, ["token", "ga"]).join(two, ["token", "gb"]).where(f"na <= fb AND nb <= fa AND greatest(na, nb) > {x}")
    return components(group.unionByName(_verified(second.select("a", "b").distinct(), slim, texts)))


def classes(texts: DataFrame) -> DataFrame:
    """(node, id, n, root) for the rows of a stored table (node, id, text): root is the first node of the class, null without words."""
    order = _order(texts)
    marks = _marks(texts, order)
    first = saved(marks.where("n > 0").groupBy("digest").agg(F.min("node").alias("first")), "nodes")
    nodes = saved(marks.join(first.select(F.col("first").alias("node")), "node", "left_semi").select("node", "n", "sketch", "head"), "distinct")
    x = _boundary(nodes)
    found = _heavy(nodes, x, _light(nodes, x), texts)
    rooted = first.join(found.select(F.col("a").alias("first"), F.col("b").alias("root")), "first", "left").select("digest", F.coalesce("root", "first").alias("root"))
    known = marks.select("node", "id", "n", "digest")
    return known.where("n > 0").join(rooted, "digest").select("node", "id", "n", "root").unionByName(known.where("n = 0").select("node", "id", "n", F.lit(None).cast("long").alias("root")))


def jaccard_classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): the smallest id that is reachable over links."""
    texts = saved(docs.select(F.monotonically_increasing_id().alias("node"), F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text")), "texts")
    found = saved(classes(texts), "classes")
    least = found.where("n > 0").groupBy("root").agg(F.min("id").alias("component_id"))
    linked = found.where("n > 0").join(least, "root").select("id", "n", "component_id")
    return linked.unionByName(found.where("n = 0").select("id", "n", F.col("id").alias("component_id"))).select("id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def without_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those that an earlier one (smaller id, nulls last; then row) is linked to, over any number of links."""
    row = free_name(docs, "__row")
    rows = saved(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = saved(classes(rows.select(F.col(row).alias("node"), F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"))), "classes")
    rank = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("node"))
    kept = found.where("n > 0").groupBy("root").agg(F.min(rank).alias("r")).select("r.node").unionByName(found.where("n = 0").select("node"))
    return rows.join(kept.withColumnRenamed("node", row), row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
