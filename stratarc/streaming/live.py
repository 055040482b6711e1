"""The indexes kept current over a stream of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from stratarc.functions import urls as U
from stratarc.operators.stats import segment_progress
from stratarc.streaming.donors import DAY, DONOR, FOUND, PACKS, NearestDonors, PackedDonors, packed, unpacked  # noqa: F401


def deduped(stream: DataFrame, id_column: str = "custom_id", watermark: str | None = None, ts: str = "archived_ts") -> DataFrame:
    """A record seen again changes nothing.  State is unbounded for exact results; a watermark bounds it."""
    if watermark:
        return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([id_column])
    return stream.dropDuplicates([id_column])


def live_totals(stream: DataFrame) -> DataFrame:
    return stream.groupBy().agg(F.count("*").alias("records"), F.count_if(F.col("rec_type") == "response").alias("responses"))


def live_newest(stream: DataFrame, key: str = "uri") -> DataFrame:
    return stream.where(F.col(key) != "").groupBy(key).agg(F.max("archived_ts").alias("last_archived_ts"))


def _of_group(key: Column, n: str = "__n") -> Column:
    """A group's key, for a condition on groups: with their count in it, it is not asked of (and a URL not parsed for) every row before."""
    return F.when(F.col(n) > 0, key)


def live_newest_host(stream: DataFrame) -> DataFrame:
    hosts = stream.groupBy(U.normal_host(U.url_parts(F.col("uri")).hostname).alias("host")).agg(F.max("archived_ts").alias("last_archived_ts"), F.count("*").alias("__n"))
    return hosts.where(_of_group(F.col("host")) != "").drop("__n")


def live_progress(reports: DataFrame) -> DataFrame:
    """Furthest place and largest counts per segment; stale reports cannot lower them.  Files are summed at the sink."""
    return reports.groupBy("file_name", "segment").agg(F.max("at").alias("at"), F.max("records").alias("records"), F.max("responses").alias("responses"), F.max("done").alias("done"))


def live_timeline(stream: DataFrame, watermark: str | None = None) -> DataFrame:
    """Captures per day: tumbling windows of one day."""
    rows = stream.withWatermark("archived_ts", watermark) if watermark else stream
    return rows.groupBy(F.window("archived_ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")


def live_nodes(stream: DataFrame) -> DataFrame:
    """Own records per tree node; in update mode each micro-batch gives only the nodes it changed."""
    return stream.groupBy(U.node_url(F.col("uri")).alias("node")).agg(F.count("*").alias("records")).where(_of_group(F.col("node"), "records").isNotNull())


def _run(df: DataFrame, step, path: str, mode: str = "append") -> None:
    """Run a stream over all that is there, each micro-batch through ``step(batch, number)``."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(step).trigger(availableNow=True).start()
    query.awaitTermination()


def _table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What the micro-batches up to now have written, with their number ``__n``; an empty batch of number -1 makes the table."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/__n=-1")
    return spark.read.schema(StructType([*schema.fields, StructField("__n", LongType())])).parquet(path)


def live_notices(stream: DataFrame, path: str, order: str = "seq", keep: int | None = 500) -> DataFrame:
    """The newest ``keep`` notices, distinct by (target, reason), the first occurrence kept (T7); all of them without ``keep``.

    The state is a table of at most ``keep`` rows for each micro-batch, written anew under the batch's number, so that
    a batch that runs again gives the same; a restart goes on from the newest table.  A notice that was trimmed is
    reported again when it comes again.  Without ``keep`` they are keyed state of Spark's own.
    """
    if keep is None:
        return drain(stream.groupBy("target", "reason").agg(F.min(order).alias(order)), "update", ["target", "reason"], path)
    spark = stream.sparkSession
    columns = ["target", "reason", order]
    schema = StructType([*(stream.schema[c] for c in columns), StructField("__batch", LongType())])

    def kept(before: int | None = None) -> DataFrame:
        """The table of the newest batch, or the newest before one."""
        rows = _table(spark, f"{path}/notices", schema)
        rows = rows if before is None else rows.where(F.col("__n") < before)
        newest = rows.agg(F.max("__n").alias("__newest"))  # one row
        return rows.join(F.broadcast(newest), F.col("__n") == F.col("__newest")).select(*columns, "__batch")

    def step(batch: DataFrame, number: int) -> None:
        held = kept(number)
        first = batch.groupBy("target", "reason").agg(F.min(order).alias(order)).select(*columns).withColumn("__batch", F.lit(number).cast("long"))
        new = first.join(F.broadcast(held.select("target", "reason")), ["target", "reason"], "left_anti")  # at most ``keep`` rows
        rows = held.unionByName(new).orderBy(F.desc("__batch"), F.desc(order), "target", "reason").limit(keep)
        rows.write.mode("overwrite").parquet(f"{path}/notices/__n={number}")

    _run(stream, step, path)
    return kept().drop("__batch")


def late_revisits(stream: DataFrame, path: str) -> DataFrame:
    """(custom_id, via, donor) of all revisits that have a donor among what the stream has read, as resolve_revisits() would give.

    Donors and revisits meet by digest and by URI in state keyed by buckets of these, to which they go in packs; a nearer
    donor that comes later gives a correction, so the order of rows and batches makes no difference.  The sink has one
    small table of packs for each micro-batch; of a revisit the newest row counts, and one by digest before one by URI.
    No batch reads what earlier ones have read.
    """
    spark = stream.sparkSession
    revisit = F.col("rec_type") == "revisit"
    donor = F.coalesce((F.col("rec_type") != "revisit") & F.col("payload_size").isNotNull(), F.lit(False))
    at = lambda c: F.unix_micros(c.cast("timestamp"))
    own, other = at(F.col("archived_ts")), at(F.coalesce("refers_to_date", "archived_ts"))
    kind = {"byte_offset": "long", "status": "int", "payload_size": "long"}
    details = [F.when(F.lit(c == "custom_id") | donor, F.col(c).cast(kind.get(c, "string"))).alias(c) for c in DONOR]
    keys = ["digest", F.when(revisit, F.col("refers_to_uri")).otherwise(F.col("uri")).alias("uri"), own.alias("own"), F.when(revisit, other).otherwise(own).alias("other")]
    keyed = stream.where(revisit | donor).select(donor.alias("donor"), *details, *keys).mapInArrow(packed, PACKS)
    found = keyed.groupBy("via", "bucket").transformWithState(PackedDonors(), "pack binary", "Update", "None")
    schema = found.schema

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/donors/__n={number}")

    _table(spark, f"{path}/donors", schema)
    provider, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    old = spark.conf.get(provider)
    spark.conf.set(provider, rocks)  # the one that has state by key and name
    try:
        _run(found, step, path, "update")
    finally:
        spark.conf.set(provider, old)
    rows = _table(spark, f"{path}/donors", schema).mapInArrow(unpacked, f"{FOUND}, __n long")
    shown = F.struct("file_name", "byte_offset", F.col("donor_id").alias("custom_id"), F.timestamp_micros("archived_us").alias("archived_ts"), *DONOR[3:])
    newest = F.min_by(F.struct("via", shown.alias("donor")), F.struct("via", -F.col("__n")))
    return rows.groupBy("custom_id").agg(newest.alias("r")).select("custom_id", "r.*")


def drain(df: DataFrame, mode: str, keys: list[str] | None, path: str) -> DataFrame:
    """Run a stream over all that is there and give its final table, from parquet at ``path``.

    Each micro-batch is written with its number; of an updated key the last row counts.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/__n={number}")

    _run(df, sink, path, mode)
    spark = df.sparkSession
    rows = spark.read.schema(StructType([*df.schema.fields, StructField("__batch", IntegerType())])).parquet(f"{path}/rows")
    rows = rows.select(*df.columns, "__batch")
    if mode == "append":
        return rows.drop("__batch")
    if not keys:
        top = rows.agg(F.max_by(F.struct(*df.columns), "__batch").alias("r"))
        return top.select("r.*")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), "__batch").alias("r")).select("r.*")


def progress_of_files(segments_seen: DataFrame, segments: DataFrame) -> DataFrame:
    return segment_progress(segments_seen, segments)
