"""Merkle manifest of a dataset over SHA midstate trees.

Rows are leaves; per group (a language, say) they ascend by id, every ``ARITY`` consecutive nodes have one parent until
one node is left, and the groups' nodes, by group, have one tree above them in the same way.

A parent is hashed child by child, and the hash state *before each child slot* is kept as a copy.  Folding a changed
child up resumes the state before its slot with the replacement and the siblings on its right only; what stands on
its left is never hashed again.

Spark's part: leaves are digests made by SQL functions; only these (32 bytes) are exchanged, never texts.  They are
sorted by range, so that a group with a third or all of the rows is dealt over all tasks; positions are prefix sums of
the counts of each sorted partition.  Trees are built a pass of ``LEVELS`` levels at a time: blocks of
ARITY ** LEVELS nodes meet in a task, give one node each, and these are the next pass's nodes.  Afterwards paths go
down the same blocks: each gets its own path to the root as one more row before its nodes.  No task holds more than
one block and one path, and every pass is a table in the shared folder.

Defined cases: null fields are ``-``, which no value can be (values begin with their length); null ids come first and
are never marked by an id; rows with equal ids go by their digests, and repeated rows are leaves each; a null group is a
group of its own, before all others; an empty table has no leaves and gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratarc.llm.common import runs, saved

ARITY, LEVELS = 8, 3
BLOCK = ARITY**LEVELS
#: Nodes of a path, from a block up: the slot taken in each parent, and all digests of the parent's children.
PATH = "array<struct<slot:int,nodes:array<binary>>>"


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (binary) over each field as its length in bytes, a colon and its value; ``-`` for null."""
    coded = []
    for f in fields:
        value = f.cast("string")
        coded.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*coded).cast("binary"), 256))


def height(n: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Parent:
    """A hashed row of children, with the states before each slot."""

    __slots__ = ("states", "kids", "digest")

    def __init__(self, kids: list[bytes]):
        self.kids = [k.hex().encode() for k in kids]
        self.states = []
        state = hashlib.sha256()
        for k in self.kids:
            self.states.append(state.copy())
            state.update(k)
        self.digest = state.digest()

    def folded(self, slot: int, child: bytes) -> bytes:
        """The parent's digest with another child in a slot."""
        state = self.states[slot].copy()
        state.update(child.hex().encode())
        state.update(b"".join(self.kids[slot + 1 :]))
        return state.digest()

    def siblings(self, slot: int) -> bytes:
        return b"".join(self.kids[:slot]) + b"".join(self.kids[slot + 1 :])


def rows_of(nodes: list[bytes], levels: int) -> list[list[Parent]]:
    """Parents by level over the nodes of one block."""
    out = []
    for _ in range(levels):
        out.append([Parent(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)])
        nodes = [p.digest for p in out[-1]]
    return out


def path_of(tree: list[list[Parent]], at: int) -> list[tuple[int, Parent]]:
    """(slot, parent) from the node at a place of the block up to the block's own node."""
    out = []
    for level in tree:
        out.append((at % ARITY, level[at // ARITY]))
        at //= ARITY
    return out


def fold(node: bytes, path: list[tuple[int, Parent]]) -> bytes:
    for slot, parent in path:
        node = parent.folded(slot, node)
    return node


def _ranked(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Adds pos, the place inside its tree in the order of tree and ``by``, and n, the nodes of its tree."""
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first(c) for c in ("tree", *by)]
    rows = nodes.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = saved(rows.withColumn("part", F.shiftright("at", 33)), "ordered")
    # a row for each tree and part: trees lie one after the other, so there are no more rows than parts and trees, and no tree has more than there are parts
    counts = rows.groupBy("tree", "part").agg(F.count("*").alias("k"), F.min("at").alias("first"))
    of = Window.partitionBy("tree")
    starts = counts.select("tree", "part", "first", F.sum("k").over(of).alias("n"), (F.sum("k").over(of.orderBy("part")) - F.col("k")).alias("start"))
    return rows.join(starts, ["tree", "part"]).withColumn("pos", F.col("start") + F.col("at") - F.col("first")).drop("part", "at", "first", "start")


def _blocks(nodes: DataFrame, run, schema: str) -> DataFrame:
    """run(tree, block, columns) for each block of the nodes, which carry tree and pos; a row at pos -1 - block precedes its block's nodes."""
    names = nodes.columns
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.when(F.col("pos") < 0, -1 - F.col("pos")).otherwise(F.floor(F.col("pos") / BLOCK)).cast("long")

    def wrapped(batches):
        for t in runs(batches, "tree", "block"):
            yield from run(t)

    dealt = nodes.withColumn("block", block).repartition(parts, "tree", "block").sortWithinPartitions("tree", "block", "pos")
    return dealt.select(*names, "block").mapInArrow(wrapped, schema)


def _up(t: pa.Table):
    nodes, n = t.column("node").to_pylist(), t.column("n")[0].as_py()
    tree = rows_of(nodes, min(LEVELS, height(n)))
    top = tree[-1][0].digest if tree else nodes[0]
    yield pa.RecordBatch.from_arrays(
        [t.column("tree").slice(0, 1).combine_chunks(), pa.array([t.column("block")[0].as_py()], pa.int64()), pa.array([-(-n // BLOCK)], pa.int64()), pa.array([top], pa.binary())],
        names=["tree", "pos", "n", "node"],
    )


def _passes(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of each pass, (tree, pos, n, node); the last has one node for each tree."""
    out = [nodes]
    while out[-1].where("n > 1").limit(1).count():
        out.append(saved(_blocks(out[-1].select("tree", "pos", "n", "node"), _up, "tree string, pos long, n long, node binary"), "nodes"))
    return out


ARROW_PATH = pa.list_(pa.struct([("slot", pa.int32()), ("nodes", pa.list_(pa.binary()))]))


def _plain(path: list[tuple[int, Parent]]) -> list[dict]:
    return [{"slot": s, "nodes": [bytes.fromhex(k.decode()) for k in p.kids]} for s, p in path]


def _down(t: pa.Table):
    """Paths of a block's nodes, from the row with the block's own path before them."""
    above, nodes, n = t.column("path")[0].as_py(), t.column("node").to_pylist()[1:], t.column("n")[1].as_py()
    tree = rows_of(nodes, min(LEVELS, height(n)))
    paths = [_plain(path_of(tree, i)) + above for i in range(len(nodes))]
    at = t.slice(1)
    yield pa.RecordBatch.from_arrays([at.column("tree").combine_chunks(), at.column("pos").combine_chunks(), pa.array(paths, ARROW_PATH)], names=["tree", "pos", "path"])


def _headed(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The nodes, and before each block a row with its path."""
    return nodes.unionByName(paths.select("tree", (-1 - F.col("pos")).alias("pos"), "path"), allowMissingColumns=True)


def _paths(passes: list[DataFrame], top: DataFrame) -> DataFrame:
    """(tree, pos, path) of the nodes of the second pass, that is of the blocks of the first; top: of each tree's last node."""
    paths = top
    for nodes in passes[:0:-1]:
        if nodes is not passes[-1]:
            paths = saved(_blocks(_headed(nodes.select("tree", "pos", "n", "node"), paths), _down, f"tree string, pos long, path {PATH}"), "paths")
    return paths


def manifest(docs: DataFrame, fields: list[str], id_column: str = "doc_id", group: str = "lang", changed: tuple[Column, dict[str, Column]] | None = None, proofs: bool = False) -> DataFrame:
    """Per row: id, leaf, subroot, root (binary), proof_sha256 (over the hex of all siblings), folded_root.

    ``changed`` is a condition and other expressions of some fields: where it holds, the leaf that is folded is made of
    these.  ``proofs`` adds ``proof``: per level the slot and the digests of all children of the parent.
    """
    cols = {c: F.col(f"`{c}`") for c in fields}
    asked = F.lit(None).cast("binary")
    if changed is not None:
        asked = F.when(changed[0], leaf_digest([changed[1].get(c, cols[c]) for c in fields]))
    kept = F.col(f"`{group}`").cast("string")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("+"), kept), F.lit("")).alias("tree"), F.col(f"`{id_column}`").alias("id"), leaf_digest(list(cols.values())).alias("node"), asked.alias("asked")
    )
    first = saved(_ranked(leaves, ["id", "node", "asked"]), "leaves")
    forest = _passes(first)
    subroots = forest[-1].select(F.lit("").alias("tree"), F.col("tree").alias("group"), "node")
    tops = saved(_ranked(subroots, ["group"]), "subroots")
    crown = _passes(tops)
    empty = crown[-1].select("tree", F.lit(0).cast("long").alias("pos"), F.expr(f"cast(array() as {PATH})").alias("path"))
    # the crown's first pass holds the groups' nodes: their paths need the places' names
    if len(crown) > 1:
        over = _blocks(_headed(tops.select("tree", "pos", "n", "node"), _paths(crown, empty)), _down, f"tree string, pos long, path {PATH}")
    else:
        over = empty
    over = saved(over.join(tops.select("tree", "pos", F.col("group")), ["tree", "pos"]).select(F.col("group").alias("tree"), F.lit(0).cast("long").alias("pos"), "path"), "paths")
    blocks = _paths(forest, over)
    id_type = leaves.schema["id"].dataType.simpleString()
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"] + ["proof"] * proofs
    schema = f"id {id_type}, leaf binary, subroot binary, root binary, proof_sha256 string, folded_root binary" + f", proof {PATH}" * proofs

    def finish(t: pa.Table):
        above, nodes, asked, n = t.column("path")[0].as_py(), t.column("node").to_pylist()[1:], t.column("asked").to_pylist()[1:], t.column("n")[1].as_py()
        tree = rows_of(nodes, min(LEVELS, height(n)))
        upper = [(x["slot"], Parent(x["nodes"])) for x in above]
        own = tree[-1][0].digest if tree else nodes[0]
        inside = height(-(-n // BLOCK))  # of the levels above the block, those below the group's node
        subroot = upper[inside - 1][1].digest if inside else own
        root = upper[-1][1].digest if upper else own
        rest = b"".join(p.siblings(s) for s, p in upper)
        proof, folded, whole = [], [], []
        for i, (node, other) in enumerate(zip(nodes, asked)):
            path = path_of(tree, i)
            proof.append(hashlib.sha256(b"".join(p.siblings(s) for s, p in path) + rest).hexdigest())
            folded.append(fold(node if other is None else other, path + upper))
            if proofs:
                whole.append(_plain(path) + above)
        at, k = t.slice(1), len(nodes)
        out = [at.column("id").combine_chunks(), pa.array(nodes, pa.binary()), pa.array([subroot] * k, pa.binary()), pa.array([root] * k, pa.binary()), pa.array(proof, pa.string()), pa.array(folded, pa.binary())]
        if proofs:
            out.append(pa.array(whole, ARROW_PATH))
        yield pa.RecordBatch.from_arrays(out, names=names)

    return _blocks(_headed(first.select("tree", "pos", "n", "node", "id", "asked"), blocks), finish, schema)
