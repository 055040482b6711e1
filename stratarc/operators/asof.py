"""Nearest capture in time (J2, J3, J12), over a stored time index.

A lookup takes the candidate of its key with the least absolute distance in time, the first in file order among
equals; without a date it takes the newest.  ``time_index`` writes the candidates once:

* *numbered*: each candidate under a number ``__rid``; numbers ascend in file order, so that ties in time are settled by
  numbers alone.  Candidates with several keys are numbered once for all of them (``time_indexes``).  *details* are the same
  in buckets by number, written only for what asks again and again.
* *leaves*: per key and node the moments and numbers of up to ``NODE`` candidates in time order, one for each moment, in
  buckets by key; each leaf also has the last entry before it and the first behind it.
* *upper levels*, only for keys with more: the first moments of up to ``NODE`` nodes of the level below.  Such keys are
  ranked by range partitions and prefix sums, so that no task holds a whole key, and a key or a single day of it with
  a third of all captures is many leaves.

A lookup joins one node of each level (mostly the leaf alone) and then the candidate of its hit: arrays of numbers are
searched by halves, no window runs over candidates, and no details are exchanged again, however often they are asked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratarc.functions import urls as U
from stratarc.operators.stored import stored, stored_by

FILE_ORDER = ("file_name", "byte_offset", "custom_id")
#: Entries of one node.
NODE = 1024
NEWEST = 1 << 62


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _up_to(values: str, limit: Column) -> Column:
    """How many of the ascending numbers (NODE + 2 at most) are at most the limit, by halves."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range((NODE + 2).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(values, n + step - 1) <= limit, n + step).otherwise(n))


@dataclass
class TimeIndex:
    numbered: DataFrame
    leaves: DataFrame
    upper: list[DataFrame]
    fields: list[str]
    details: DataFrame | None = None

    def dealt(self) -> TimeIndex:
        """Itself, with the candidates in buckets by number: for what fetches more than once."""
        if self.details is None:
            self.details = stored_by(self.numbered.select("__rid", "__cand"), "__rid", "details")
        return self

    def candidates(self) -> DataFrame:
        return self.numbered.select("__cand.*")

    def look(self, asked: DataFrame) -> DataFrame:
        """(…, __rid) for asked rows with __key and __us (micros, null for the newest); only those whose key is held stay."""
        rows = asked.withColumn("__us", F.coalesce("__us", F.lit(NEWEST))).withColumn("__node", F.lit(0).cast("long"))
        for level in self.upper:
            at = F.greatest(_up_to("__lows", F.col("__us")), F.lit(1))
            below = F.when(F.col("__below").isNull(), 0).otherwise(F.get("__below", at - 1))
            rows = rows.join(level, ["__key", "__node"], "left").withColumn("__next", below).drop("__lows", "__below", "__node").withColumnRenamed("__next", "__node")
        met = rows.join(self.leaves, ["__key", "__node"])
        met = met.withColumn("__n", _up_to("__moments", F.col("__us")))
        b, a = F.get("__rids", F.col("__n") - 1), F.get("__rids", F.col("__n"))
        gb, ga = F.col("__us") - F.get("__moments", F.col("__n") - 1), F.get("__moments", F.col("__n")) - F.col("__us")
        rid = F.when(a.isNull(), b).when(b.isNull(), a).when((gb < ga) | ((gb == ga) & (b < a)), b).otherwise(a)
        return met.withColumn("__rid", rid).drop("__moments", "__rids", "__n", "__us", "__node")

    def fetch(self, rows: DataFrame) -> DataFrame:
        """The rows (with ``lookup_id``) with ``hit``, the candidate under their number, or null."""
        # rows without a number are spread: no candidate has one below zero
        spread = rows.withColumn("__rid", F.coalesce("__rid", -1 - F.pmod(F.xxhash64("lookup_id"), F.lit(1 << 30))))
        held = self.numbered.select("__rid", "__cand") if self.details is None else self.details
        return spread.join(held, "__rid", "left").withColumnRenamed("__cand", "hit").drop("__rid")


def _node(rows: DataFrame, node: Column, value: str, number: str, names: tuple[str, str]) -> DataFrame:
    """Entries gathered by key and node, ascending."""
    both = F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), F.col(number).alias("i"))))
    return rows.groupBy("__key", node.alias("__node")).agg(both.alias("b")).select("__key", "__node", F.col("b.v").alias(names[0]), F.col("b.i").alias(names[1]))


def _ranked(line: DataFrame, by: str) -> DataFrame:
    """Adds __pos, the place within its key in the order of ``by``: range partitions, and prefix sums of their counts."""
    n = int(line.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(line.repartitionByRange(n, "__key", by).sortWithinPartitions("__key", by).withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)), "ranked")
    counts = rows.groupBy("__key", "__part").agg(F.count("*").alias("__k"), F.min("__at").alias("__first"))
    along = Window.partitionBy("__key").orderBy("__part")  # as many rows as there are parts
    starts = counts.select("__key", "__part", (F.sum("__k").over(along) - F.col("__k") - F.col("__first")).alias("__shift"))
    return rows.join(starts, ["__key", "__part"]).withColumn("__pos", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


def _deep(line: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Leaves and upper levels (the top first) of keys with more entries than a node takes."""
    ranked = _ranked(line, "__us")
    node, slot = F.floor(F.col("__pos") / NODE), F.col("__pos") % NODE
    # the first entry also ends the leaf before, the last one begins the leaf behind
    nodes = F.filter(F.array(node, F.when((slot == 0) & (node > 0), node - 1), F.when(slot == NODE - 1, node + 1)), lambda x: x.isNotNull())
    leaves = _node(ranked.withColumn("__of", F.explode(nodes)), F.col("__of"), "__us", "__rid", ("__moments", "__rids"))
    leaves = leaves.where(F.size("__moments") > 1)  # not a node of an end alone
    below, upper = ranked.where(slot == 0).select("__key", "__us", node.alias("__child")), []
    while True:
        below = stored(below, "level")
        level = _node(below, F.floor(F.col("__child") / NODE), "__us", "__child", ("__lows", "__below"))
        upper.insert(0, stored_by(level, "__key", "upper"))
        if not below.where(F.col("__child") >= NODE).limit(1).count():
            return leaves, upper
        below = below.where(F.col("__child") % NODE == 0).select("__key", "__us", F.floor(F.col("__child") / NODE).alias("__child"))


def time_indexes(candidates: DataFrame, keys: list[str], ts: str = "archived_ts", groups: DataFrame | None = None) -> list[TimeIndex]:
    """An index for each of the keys, over candidates that are numbered and written once.

    ``groups``: the only keys (``__key``) that are held, some of them without candidates.
    """
    fields = [c for c in candidates.columns if c not in keys]
    n = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = candidates.where(F.coalesce(*(F.col(k) for k in keys)).isNotNull() & F.col(ts).isNotNull())
    named = [F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]
    numbered = rows.repartitionByRange(n, *FILE_ORDER).sortWithinPartitions(*FILE_ORDER).select(F.monotonically_increasing_id().alias("__rid"), *named, _micros(F.col(ts)).alias("__us"), F.struct(*(F.col(f"`{c}`") for c in fields)).alias("__cand"))
    numbered = stored(numbered, "numbered")
    return [_indexed(numbered, f"__key{i}", fields, groups) for i in range(len(keys))]


def _indexed(numbered: DataFrame, key: str, fields: list[str], groups: DataFrame | None) -> TimeIndex:
    line = numbered.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key"), "__us").agg(F.min("__rid").alias("__rid"))
    if groups is not None:
        groups = groups.select("__key").distinct()
        line = line.join(groups, "__key", "left_semi")
    line = stored(line, "line")
    sizes = line.groupBy("__key").agg(F.count("*").alias("__k"))
    hot = stored(sizes.where(F.col("__k") > NODE).select("__key"), "hot")
    upper: list[DataFrame] = []
    if hot.limit(1).count():
        leaves, upper = _deep(line.join(hot, "__key", "left_semi"))
        leaves = leaves.unionByName(_node(line.join(hot, "__key", "left_anti"), F.lit(0).cast("long"), "__us", "__rid", ("__moments", "__rids")))
    else:
        leaves = _node(line, F.lit(0).cast("long"), "__us", "__rid", ("__moments", "__rids"))
    if groups is not None:
        bare = groups.join(line.select("__key").distinct(), "__key", "left_anti")
        none = F.array().cast("array<bigint>")
        leaves = leaves.unionByName(bare.select("__key", F.lit(0).cast("long").alias("__node"), none.alias("__moments"), none.alias("__rids")))
    return TimeIndex(numbered, stored_by(leaves, "__key", "leaves"), upper, fields)


def time_index(candidates: DataFrame, key: str = "key", ts: str = "archived_ts", groups: DataFrame | None = None) -> TimeIndex:
    """Candidates with a key and a date, written for nearest().  ``groups``: the only keys (``__key``) that are held, some of them without candidates."""
    return time_indexes(candidates, [key], ts, groups)[0]


def nearest(lookups: DataFrame, candidates: DataFrame | TimeIndex, key: str = "key", near: str = "near", ts: str = "archived_ts") -> DataFrame:
    """The lookups (with a unique ``lookup_id``) with ``hit``, a struct of the candidate's columns or null.

    A null ``near`` takes the newest candidate.  Candidates need ``file_name``, ``byte_offset`` and ``custom_id``, or are
    a time_index().
    """
    index = candidates if isinstance(candidates, TimeIndex) else time_index(candidates, key, ts)
    asked = lookups.where(F.col(key).isNotNull()).select("lookup_id", F.col(key).alias("__key"), _micros(F.col(near)).alias("__us"))
    found = index.look(asked).select("lookup_id", "__rid")
    return index.fetch(lookups.join(found, "lookup_id", "left")).select(*(F.col(f"`{c}`") for c in lookups.columns), "hit")


def nearest_by_keys(lookups: DataFrame, groups: DataFrame, candidates: DataFrame | TimeIndex, url: str = "url", near: str = "near") -> DataFrame:
    """The first lookup key that has any captures decides, even if none of them can be shown.

    ``groups``: the distinct URIs held.  Adds ``key``, ``hit`` and ``outcome``: hit, no-payload or not-archived.
    ``candidates``: rows with their ``uri``, or keyed_time_index() of them.
    """
    index = candidates if isinstance(candidates, TimeIndex) else keyed_time_index(candidates, groups)
    keys = lookups.select("lookup_id", _micros(F.col(near)).alias("__us"), F.posexplode(U.lookup_keys(F.col(url))).alias("__pos", "__key"))
    first = index.look(keys).groupBy("lookup_id").agg(F.min_by(F.struct(F.col("__key").alias("key"), "__rid"), "__pos").alias("__f")).select("lookup_id", "__f.*")
    found = index.fetch(lookups.join(first, "lookup_id", "left"))
    outcome = F.when(F.col("hit").isNotNull(), "hit").when(F.col("key").isNotNull(), "no-payload").otherwise("not-archived")
    return found.select(*(F.col(f"`{c}`") for c in lookups.columns), "key", "hit", outcome.alias("outcome"))


def keyed_time_index(candidates: DataFrame, groups: DataFrame) -> TimeIndex:
    """time_index() by URI, with the URI kept among the fields; of candidates only those of the groups."""
    return time_index(candidates.withColumn("key", F.col("uri")), groups=groups.select(F.col("uri").alias("__key")))
