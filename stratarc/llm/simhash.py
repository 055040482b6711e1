"""SimHash near-duplicates with BK-trees.

A text's fingerprint has bit i set if over half of its shingles' XXH64 values have it.  Distinct fingerprints link at
``radius`` or fewer differing bits.  They are cut into blocks of bits: of ``radius`` + c blocks at least c are equal in
any link, so each choice of c blocks gives a key under which all links lie inside one bucket.  A bucket is a BK-tree:
a node's children are keyed by their integer Hamming distance to it, and a search follows only edges within the radius
of its own distance.  Buckets above ``shard`` fingerprints become several shard trees; each is sent (broadcast) to
every block of the bucket's queries, and only to those, so that no task holds more than two blocks and nothing goes
through the driver.

Links leave a task as stars (fingerprint, smallest of its group there), not as pairs; components are found by rounds
of large and small stars over the distinct fingerprints.

Defined cases: null and wordless texts have fingerprint zero and link like any other; null ids never name a component
that holds another id; repeated rows get a row each; an empty table gives an empty table; extra columns are dropped.
"""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarc.llm.common import saved

SEED = 42
MASK = (1 << 64) - 1


class BKTree:
    """Nodes by number; ``children[n]`` maps a distance to the child at that distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        n = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while n:
            below = self.children[at]
            d = (self.values[at] ^ value).bit_count()
            if d in below:
                at = below[d]
            else:
                below[d] = n
                return

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of the nodes at ``radius`` or less."""
        found, values, children = [], self.values, self.children
        open_ = [0] if values else []
        while open_:
            at = open_.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            low, high = d - radius, d + radius
            open_ += [c for e, c in children[at].items() if low <= e <= high]
        return found


def majority(hashes) -> int:
    """The bits that over half of the hashes have, as a signed number; none without any."""
    import numpy as np

    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, words: int = 4) -> int:
    """Signed 64 bits."""
    import numpy as np
    import xxhash

    parts = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(parts) - words + 1)
    return majority(np.fromiter((digest(b" ".join(parts[i : i + words]), SEED) for i in range(n)), np.uint64, n))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(t, words) for t in part.column(1).to_pylist()], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _bands(n: int, radius: int) -> list[tuple[int, ...]]:
    """Masks of key bits: the fewest equal blocks that leave at most about 256 fingerprints in a bucket, with all choices of them."""
    for equal in (1, 2, 3, 4):
        blocks = radius + equal
        edge = [64 * i // blocks for i in range(blocks + 1)]
        keys = [sum(((1 << edge[b + 1]) - (1 << edge[b])) for b in chosen) for chosen in combinations(range(blocks), equal)]
        if n <= 256 << min(k.bit_count() for k in keys):
            break
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def _stars(values: list[int], links: list[tuple[int, int]]):
    """(value, smallest linked one) by union and find."""
    up = list(range(len(values)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            if values[a] < values[b]:
                up[b] = a
            else:
                up[a] = b
    return [(values[i], values[r]) for i in range(len(values)) if (r := root(i)) != i]


def linked(fps: DataFrame, radius: int = 4, shard: int = 1024) -> DataFrame:
    """Stars (a, b), b < a, whose components are those of all links between the distinct fingerprints ``fp``."""
    n = fps.count()
    bands = _bands(n, radius)
    keyed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(bands)))).alias("k"))
    keyed = keyed.select("fp", "k.band", "k.key")
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("n"))
    keyed = saved(keyed.join(sizes.where(f"n > {shard}"), ["band", "key"], "left").withColumn("shards", F.coalesce(F.ceil(F.col("n") / shard), F.lit(1)).cast("int")), "bands")
    own = F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int")
    # as tree for the shards from its own on, as query for those before it
    dealt = keyed.select("fp", "band", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other")).select(
        "fp", "band", "key", F.least("own", "other").alias("tree"), F.greatest("own", "other").alias("block"), (F.col("own") > F.col("other")).alias("query")
    )
    where = ["band", "key", "tree", "block"]

    def run(batches):
        group, tree, values, links = None, BKTree(), [], []
        out: list[tuple[int, int]] = []
        for b in batches:
            for fp, *at, query in zip(*(b.column(i).to_pylist() for i in range(6))):
                if at != group:
                    out += _stars(values, links)
                    group, tree, values, links = at, BKTree(), [], []
                bits, me = fp & MASK, len(values)
                links += [(i, me) for i in tree.within(bits, radius)]
                values.append(fp)
                if not query:  # these come first, so that a node has one number in both lists
                    tree.add(bits)
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
                out = []
        out += _stars(values, links)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, *where).sortWithinPartitions(*where, "query").select("fp", *where, "query").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every vertex of the edges but the smallest of its component, with that smallest one."""
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        # large stars: higher neighbours of u go to the smallest neighbour of u (u itself counts)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.withColumnRenamed("a", "u").where("b > u").join(least, "u").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small stars: u and its lower neighbours go to the smallest of these
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.withColumnRenamed("a", "u").join(low, "u").select(F.explode(F.array("u", "b")).alias("a"), F.col("m").alias("b"))
        edges = saved(small.where("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before or not now[0]:
            return edges
        before = now


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id that is reachable over links."""
    fps = saved(fingerprints(docs, id_column, text, words), "fingerprints")
    nodes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(linked(nodes.select("fp"), radius)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = saved(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")
