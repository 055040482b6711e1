"""Chat formatting over reply trees, in DataFrame operations only.

Messages point to the message they answer.  Self-joins of doubling reach (to the parent, then 2, 4, 8 ... above) list
for every leaf all messages between it and its root, in as many rounds as the logarithm of the depth.  The paths of a
tree are ranked by score, and each chosen path becomes one conversation: turns in order, each with its role, its text
and an end mark; control strings inside are escaped reversibly.

Defined cases: null texts and roles are empty; a message whose parent is null or absent is a root; null scores count
as 0; ties between paths go to the smaller leaf id; an empty table gives an empty table.  Messages in a cycle reach no
root and belong to no path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from stratarc.llm.common import saved

#: The template (fixed values of this library).
HEAD, COLON, END = "### ", ": ", " </turn>\n"
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"), ("\n", "\\n"))
LOSS_ROLE = "assistant"


def _replaced(text: Column, pairs) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escaped(text: Column, pairs=ESCAPES) -> Column:
    return _replaced(F.coalesce(text, F.lit("")), pairs)


def unescaped(text: Column, pairs=ESCAPES) -> Column:
    return _replaced(text, [(b, a) for a, b in reversed(pairs)])


def leaf_paths(messages: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """(leaf, node, up): every message on the way from a leaf to its root, ``up`` steps above the leaf.

    ``node`` is unique.  Paths that end in a cycle are left out.
    """
    links = saved(messages.select(F.col(f"`{node}`").alias("node"), F.col(f"`{parent}`").alias("parent")), "links")
    ids = links.select("node")
    jumps = saved(links.join(ids.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", F.col("parent").alias("above")), "jumps")
    leaves = ids.join(jumps.select(F.col("above").alias("node")), "node", "left_anti")
    paths = leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    steps, most = 1, ids.count()
    while not jumps.isEmpty() and steps <= most:
        higher = paths.join(jumps, "node").select("leaf", F.col("above").alias("node"), (F.col("up") + steps).alias("up"))
        paths = saved(paths.unionByName(higher), "paths")
        far = jumps.select(F.col("node").alias("above"), F.col("above").alias("top"))
        jumps = saved(jumps.join(far, "above").select("node", F.col("top").alias("above")), "jumps")
        steps *= 2
    if steps > most:  # a cycle: keep the paths that reach a root
        roots = links.join(ids.select(F.col("node").alias("parent")), "parent", "left_anti").select("node")
        paths = paths.join(paths.join(roots, "node", "left_semi").select("leaf"), "leaf", "left_semi")
    return paths


def format_trees(messages: DataFrame, tree: str = "tree", node: str = "node", parent: str = "parent", role: str = "role", text: str = "text", score: str | None = None, best: int | None = None) -> DataFrame:
    """One row per chosen path: tree, leaf, rank, path_score, formatted, loss_spans (start and length in code points).

    ``best``: how many paths of a tree are taken (all if None), by the mean score of their messages.
    """
    rows = messages.select(
        F.col(f"`{tree}`").alias("tree"),
        F.col(f"`{node}`").alias("node"),
        F.col(f"`{parent}`").alias("parent"),
        F.concat(F.lit(HEAD), escaped(F.col(f"`{role}`"), ROLE_ESCAPES), F.lit(COLON)).alias("head"),
        escaped(F.col(f"`{text}`")).alias("body"),
        (F.coalesce(F.col(f"`{role}`"), F.lit("")) == LOSS_ROLE).alias("loss"),
        (F.coalesce(F.col(f"`{score}`"), F.lit(0)) if score else F.lit(0)).cast("double").alias("score"),
    )
    turns = leaf_paths(rows).join(rows.drop("parent"), "node")
    path = Window.partitionBy("leaf")
    before = path.orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(END))).withColumn("start", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.length("head"))
    made = turns.groupBy("leaf").agg(
        F.first("tree").alias("tree"),
        F.avg("score").alias("path_score"),
        F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "turn", "loss", "start", F.length("body").alias("n")))).alias("turns"),
    )
    made = made.select(
        "tree",
        "leaf",
        "path_score",
        F.array_join("turns.turn", "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t.loss), lambda t: F.struct(t.start.cast("long").alias("start"), t.n.cast("long").alias("length"))).alias("loss_spans"),
    )
    if best is None:
        return made.withColumn("rank", F.lit(None).cast("int"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf"))
    return made.withColumn("rank", rank).where(F.col("rank") <= best)


def turns_of(formatted: Column) -> Column:
    """The turns read back from a formatted conversation: an array of (role, text)."""
    cut = F.split(formatted, " </turn>\n")
    heads = F.slice(cut, F.lit(1), F.greatest(F.size(cut) - 1, F.lit(0)))
    at = lambda t: F.instr(t, COLON)
    return F.transform(
        heads,
        lambda t: F.struct(
            unescaped(F.substring(t, F.lit(len(HEAD) + 1), at(t) - (len(HEAD) + 1)), ROLE_ESCAPES).alias("role"),
            unescaped(F.substring(t, at(t) + len(COLON), F.length(t))).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, one span after the other."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, (s.start + 1).cast("int"), s.length.cast("int")))), "")


def linear_tree(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations kept as numbered turns, as trees without branches: each turn answers the one before."""
    order = Window.partitionBy(conv).orderBy(turn, role, text)
    key = F.coalesce(F.col(conv).cast("string"), F.lit(""))
    return conversations.withColumn("__n", F.row_number().over(order)).select(
        F.col(conv).alias("tree"),
        F.concat_ws(":", key, F.col("__n")).alias("node"),
        F.when(F.col("__n") > 1, F.concat_ws(":", key, F.col("__n") - 1)).alias("parent"),
        F.col(role).alias("role"),
        F.col(text).alias("text"),
    )
