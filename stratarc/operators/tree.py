"""URL trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratarc.functions import headers as H
from stratarc.functions import urls as U
from stratarc.functions.hrefs import let
from stratarc.operators.search import matches, natural_key
from stratarc.operators.stored import stored


def nodes(captures: DataFrame, normal: bool = False) -> DataFrame:
    """One row per node: url, parent, segment, depth, own records, children.

    Rows are counted per URL first, so that paths are exploded per distinct URL and a hot URL is one row; with the count
    in them, conditions on paths are asked of URLs too, not of all their rows before.
    """
    uris = captures.groupBy("uri").agg(F.count("*").alias("n")).select(F.when(F.col("n") > 0, U.node_path(F.col("uri"), normal)).alias("path"), "n").where("path IS NOT NULL")
    steps = uris.select("n", F.size("path").alias("size"), F.posexplode("path").alias("depth", "node"))
    found = steps.groupBy("node").agg(F.min("depth").cast("int").alias("depth"), F.sum(F.when(F.col("depth") == F.col("size") - 1, F.col("n")).otherwise(0)).alias("records"))
    found = found.withColumn("parent", U.parent_url(F.col("node"))).withColumn("segment", segment(F.col("node"), F.col("parent")))
    children = found.where("parent IS NOT NULL").groupBy(F.col("parent").alias("__p")).agg(F.count("*").alias("children"))
    return found.join(children, F.col("node") == F.col("__p"), "left").drop("__p").withColumn("children", F.coalesce("children", F.lit(0)))


def segment(node: Column, parent: Column) -> Column:
    """What a node adds to its parent; of a root its host."""
    host = F.regexp_replace(F.regexp_replace(node, "^[^/]*://", ""), "/$", "")
    return F.when(parent.isNull(), host).when(node.contains("?"), F.regexp_extract(node, r"(?s)(\?.*)$", 1)).otherwise(F.regexp_extract(node, r"([^/]*)$", 1))


def segments(tree: DataFrame) -> DataFrame:
    return tree.groupBy("segment").agg(F.count("*").alias("nodes"))


def find_segments(tree: DataFrame, query: str) -> DataFrame:
    """Nodes that bear a segment with the text; an empty query finds none."""
    text = query.strip()
    return tree.where(matches(F.col("segment"), text)).select("node") if text else tree.where("false").select("node")


def find_type(captures: DataFrame, content_type: str, normal: bool = False) -> DataFrame:
    rows = captures.where(H.content_essence(F.col("content_type_raw")) == content_type).groupBy("uri").agg(F.count("*").alias("n"))
    return rows.select(F.when(F.col("n") > 0, U.node_url(F.col("uri"), normal)).alias("node")).where("node IS NOT NULL").distinct()


def intersect(a: DataFrame | None, b: DataFrame | None) -> DataFrame | None:
    """An unset side is neutral, an empty one gives nothing."""
    return b if a is None else a if b is None else a.join(b, "node", "left_semi")


def tree_filter(tree: DataFrame, matched: DataFrame) -> DataFrame:
    """(node, matched): matched nodes and all their ancestors that the tree has."""
    web = matched.select(F.explode(ancestors(F.col("node"))).alias("node"), F.col("node").alias("of"))
    kept = web.groupBy("node").agg(F.bool_or(F.col("node") == F.col("of")).alias("matched"))
    return kept.join(tree.select("node"), "node", "left_semi")


def ancestors(node: Column) -> Column:
    """The node and all nodes above it, root first, however deep it is."""
    base = F.regexp_extract(node, r"^((?:[^/]*://)?[^/]*/)", 1)
    path = F.regexp_replace(F.split_part(node, F.lit("?"), F.lit(1)), "/$", "")
    rest = F.filter(F.split(F.substring(path, F.length(base) + 1, F.length(path)), "/"), lambda s: s != "")
    walk = F.transform(F.sequence(F.lit(0), F.size(rest)), lambda i: F.when(i == 0, base).otherwise(F.concat(base, F.array_join(F.slice(rest, F.lit(1), i), "/"))))
    return F.array_distinct(F.concat(walk, F.array(node)))


def way(node: Column) -> Column:
    """A node's place in pre-order: of each node from the root the natural key, then what it adds to the node above it.

    Whole URLs would order the same, since those above are equal by then, but take the square of a deep node's length.
    """
    name = lambda p: F.regexp_extract(F.regexp_replace(p, "/$", ""), r"([^/]*)$", 1)

    def placed(path: Column) -> Column:
        above = lambda i: F.get(path, i - 1)
        added = lambda p, i: F.when(p.startswith(above(i)), F.substring(p, F.length(above(i)) + 1, F.length(p))).otherwise(p)
        return F.transform(path, lambda p, i: F.struct(natural_key(name(p)).alias("k"), added(p, i).alias("url")))

    return let(ancestors(node), placed)


def visible_rows(tree: DataFrame, open_nodes: DataFrame | None = None, kept: DataFrame | None = None) -> DataFrame:
    """Nodes in pre-order with their depth: children only of open nodes; under a filter kept nodes and what is below a match."""
    rows, path = tree, ancestors(F.col("node"))
    if open_nodes is not None:
        shut = rows.select("node", F.explode(F.slice(path, F.lit(1), F.size(path) - 1)).alias("__up")).join(open_nodes.select(F.col("node").alias("__up")), "__up", "left_anti").select("node").distinct()
        rows = rows.join(shut, "node", "left_anti")
    if kept is not None:
        below = rows.select("node", F.explode(path).alias("__up")).join(kept.where("matched").select(F.col("node").alias("__up")), "__up", "left_semi").select("node").distinct()
        rows = rows.join(kept.select("node").unionByName(below).distinct(), "node", "left_semi")
    return rows.select("node", "depth", "records", way(F.col("node")).alias("sort_key"))


def numbered(rows: DataFrame, key: str = "sort_key", name: str = "pos") -> DataFrame:
    """The rows with their dense place in the order of the key, from 0; keys are unique, as those of visible rows are.

    Rows are dealt by ranges of the key and stored with the number of their range, so that a task that runs again cannot
    deal them otherwise; a row's place is its place in the range behind the sizes of the ranges before.  No task orders
    all rows: only sizes, one for each range, are summed in one.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part, at, size, before = (f"__{name}_{x}" for x in ("part", "at", "size", "before"))
    dealt = stored(rows.repartitionByRange(n, key).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(part).agg(F.count("*").alias(size))
    starts = sizes.select(F.col(part), (F.sum(size).over(Window.orderBy(part)) - F.col(size)).alias(before))
    placed = dealt.withColumn(at, F.row_number().over(Window.partitionBy(part).orderBy(key)))
    return placed.join(F.broadcast(starts), part).withColumn(name, (F.col(before) + F.col(at) - 1).cast("long")).drop(part, at, before)  # a row for each range


def untreed(captures: DataFrame) -> DataFrame:
    """Records outside the trees by type and reason; without a URL only some types are expected."""
    p = U.url_parts(F.col("uri"))
    reason = F.when(F.coalesce(F.col("uri"), F.lit("")) == "", "no url").when(p.reason.isNotNull(), p.reason).when(p.origin.isNull(), "not-a-web-url")
    rows = captures.select("rec_type", reason.alias("reason")).where("reason IS NOT NULL")
    expected = (F.col("reason") == "no url") & F.col("rec_type").isin("warcinfo", "metadata")
    return rows.groupBy("rec_type", "reason").agg(F.count("*").alias("n")).withColumn("expected", expected)


def search_loaded(captures: DataFrame, tree: DataFrame, query: str, content_type: str | None = None, limit: int = 25) -> DataFrame:
    """Segment search; only if it finds no node, the whole URL.  One row per URL with count, newest date and type."""
    rows = captures.where("rec_type = 'response'")
    if content_type:
        rows = rows.where(H.content_essence(F.col("content_type_raw")) == content_type)
    # counted per URL first: nodes are looked up once for each
    grouped = rows.groupBy("uri").agg(F.count("*").alias("n"), F.max("archived_ts").alias("newest_ts"), F.max_by(H.content_essence(F.col("content_type_raw")), F.struct("archived_ts", "custom_id")).alias("content_type"))
    hit = find_segments(tree, query)
    found = hit.agg((F.count("*") > 0).alias("__any"))
    flagged = grouped.withColumn("node", U.node_url(F.col("uri"))).join(hit.withColumn("__hit", F.lit(True)), "node", "left").crossJoin(F.broadcast(found))
    grouped = flagged.where(F.when(F.col("__any"), F.coalesce("__hit", F.lit(False))).otherwise(matches(F.col("uri"), query.strip()))).drop("node", "__hit", "__any")
    return grouped.orderBy(F.desc("n"), "uri").limit(limit)
