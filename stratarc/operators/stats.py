"""Counts over captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratarc.functions import headers as H
from stratarc.functions import urls as U
from stratarc.operators.captures import browsable


def day_key(ts: Column, zone: str | None = None) -> Column:
    """The day of a moment (UTC, without zone), of the named zone with its daylight saving time if one is given."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), ts) if zone else ts
    return F.coalesce(F.date_format(local, "yyyy-MM-dd"), F.lit("invalid"))


def month_key(day: Column) -> Column:
    return F.when(day == "invalid", day).otherwise(F.substring(day, 1, 7))


def year_key(day: Column) -> Column:
    return F.when(day == "invalid", day).otherwise(F.substring(day, 1, 4))


def uri_groups(captures: DataFrame, keep: int | None = None) -> DataFrame:
    """URI, count and captures as nested rows, newest first (all, or the newest ``keep``)."""
    row = F.struct(F.col("archived_ts"), F.col("custom_id"), F.col("status"), F.col("content_type"))
    rows = F.sort_array(F.collect_list(row), asc=False)
    return captures.groupBy("uri").agg(F.count("*").alias("n"), (F.slice(rows, 1, keep) if keep else rows).alias("captures"))


def uri_captures(captures: DataFrame) -> DataFrame:
    """All captures of each URI as rows (uri, n, custom_id, archived_ts, pos), newest first.

    Positions are counted per URI and day, after the captures of later days, so that no task holds a whole URI.
    """
    dated = captures.select("uri", "custom_id", "archived_ts", F.to_date("archived_ts").alias("day"))
    days = dated.groupBy("uri", "day").agg(F.count("*").alias("k"))
    uri = Window.partitionBy("uri")
    later = F.sum("k").over(uri.orderBy(F.desc_nulls_last("day")).rowsBetween(Window.unboundedPreceding, -1))
    days = days.select(F.col("uri").alias("of"), F.col("day").alias("on"), F.sum("k").over(uri).alias("n"), F.coalesce(later, F.lit(0)).alias("later"))
    own = F.row_number().over(Window.partitionBy("uri", "day").orderBy(F.desc_nulls_last("archived_ts"), F.desc("custom_id")))
    ranked = dated.withColumn("own", own).join(days, F.col("uri").eqNullSafe(F.col("of")) & F.col("day").eqNullSafe(F.col("on")))
    return ranked.select("uri", "n", "custom_id", "archived_ts", (F.col("later") + F.col("own")).cast("long").alias("pos"))


def uri_stats(captures: DataFrame) -> DataFrame:
    return captures.groupBy("uri").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("payload_size"), F.lit(0)).cast("long").alias("total_size"), F.min("archived_ts").alias("first_ts"), F.max("archived_ts").alias("last_ts")
    )


def host_overview(captures: DataFrame, top: int = 12) -> DataFrame:
    """Responses per host (port kept), the largest first, with the number of hosts and the archive's dates on each row."""
    hosts = browsable(captures).groupBy(U.url_parts(F.col("uri")).host.alias("host")).agg(F.count("*").alias("responses"), F.min("archived_ts").alias("lo"), F.max("archived_ts").alias("hi"))
    whole = hosts.agg(F.count("*").alias("hosts"), F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts"))
    return hosts.orderBy(F.desc("responses"), "host").limit(top).select("host", "responses").crossJoin(F.broadcast(whole))


def newest_per_host(captures: DataFrame) -> DataFrame:
    """Newest capture per hostname (no port, no www.); an overall row has a null host."""
    host = U.normal_host(U.url_parts(F.col("uri")).hostname)
    return captures.where("uri <> ''").rollup(host.alias("host")).agg(F.max("archived_ts").alias("newest_ts"), F.count("*").alias("n"))


def timeline_days(captures: DataFrame, zone: str | None = None) -> DataFrame:
    """Captures per day with the peak's share: bar = max(4, 100 n / peak)."""
    days = captures.groupBy(day_key(F.col("archived_ts"), zone).alias("day")).agg(F.count("*").alias("n"))
    peak = days.agg(F.max("n").alias("peak"))
    return days.crossJoin(F.broadcast(peak)).withColumn("bar", F.greatest(F.lit(4), F.floor(100 * F.col("n") / F.col("peak"))).cast("long"))


def timeline_rollup(captures: DataFrame, zone: str | None = None) -> DataFrame:
    """Nested totals: year, month, day and all."""
    day = day_key(F.col("archived_ts"), zone)
    keyed = captures.select(year_key(day).alias("year"), month_key(day).alias("month"), day.alias("day"))
    return keyed.rollup("year", "month", "day").agg(F.count("*").alias("n"))


def distinct_days(captures: DataFrame, zone: str | None = None) -> DataFrame:
    return captures.groupBy("uri").agg(F.count("*").alias("n"), F.count_distinct(day_key(F.col("archived_ts"), zone)).alias("days"))


def capture_pattern(captures: DataFrame, zone: str | None = None) -> DataFrame:
    """URLs with one capture, several on one day, several days."""
    case = F.when(F.col("n") == 1, "one").when(F.col("days") == 1, "one day").otherwise("several days")
    return distinct_days(captures, zone).groupBy(case.alias("pattern")).agg(F.count("*").alias("urls"))


def content_types(captures: DataFrame) -> DataFrame:
    """Per essence the number of distinct tree nodes; empty types excluded."""
    uris = captures.groupBy("uri", H.content_essence(F.col("content_type_raw")).alias("content_type")).agg(F.count("*").alias("n")).where("content_type <> ''")
    nodes = uris.select("content_type", F.when(F.col("n") > 0, U.node_url(F.col("uri"))).alias("node"), "n").where("node IS NOT NULL")  # of groups, see tree.nodes()
    return nodes.groupBy("content_type", "node").agg(F.sum("n").alias("n")).groupBy("content_type").agg(F.count("*").alias("nodes"), F.sum("n").alias("captures"))


def usable_types(captures: DataFrame) -> DataFrame:
    """The collection's types that are well-formed."""
    types = captures.select(H.content_essence(F.col("content_type_raw")).alias("content_type")).distinct()
    return types.where(H.usable_content_type(F.col("content_type")))


def worst_status(captures: DataFrame) -> DataFrame:
    """Per tree node over its responses: the highest status, or the lowest if that is below 300; 1 if all are null, 0 without responses."""
    response = F.col("rec_type") == "response"
    status = F.when(response, F.col("status"))
    uris = captures.groupBy("uri").agg(F.count_if(response).alias("n"), F.max(status).alias("top"), F.min(status).alias("low"))
    nodes = uris.select(F.explode(U.node_path(F.col("uri"))).alias("node"), "n", "top", "low")
    top, low = F.max("top"), F.min("low")
    return nodes.groupBy("node").agg(F.when(F.sum("n") == 0, 0).when(top.isNull(), 1).when(top < 300, low).otherwise(top).cast("int").alias("worst"))


def redirect_bodies(captures: DataFrame, small: int = 256) -> DataFrame:
    rows = captures.where(H.is_redirect(F.col("status")))
    body = H.has_body(F.col("payload_size"))
    return rows.agg(F.count("*").alias("redirects"), F.count_if(body).alias("with_body"), F.count_if(body & (F.col("payload_size") < small)).alias("small_bodies"))


def segment_progress(reports: DataFrame, segments: DataFrame) -> DataFrame:
    """Progress per file from reports in any order: per segment the furthest place, clamped to its end, and the largest counts.

    Reports for unknown segments are ignored; a file is done when all its segments are.
    """
    best = reports.groupBy("file_name", "segment").agg(F.max("at").alias("at"), F.max("records").alias("records"), F.max("responses").alias("responses"), F.max("done").alias("done"))
    known = segments.join(best, ["file_name", "segment"], "left")
    here = F.least(F.greatest(F.coalesce("at", "start"), F.col("start")), F.col("end")) - F.col("start")
    files = known.groupBy("file_name").agg(
        F.sum(here).alias("bytes"),
        F.sum(F.col("end") - F.col("start")).alias("size"),
        F.sum(F.coalesce("records", F.lit(0))).alias("records"),
        F.sum(F.coalesce("responses", F.lit(0))).alias("responses"),
        F.min(F.coalesce("done", F.lit(False))).alias("done"),
    )
    share = F.floor(100 * F.col("bytes") / F.col("size")).cast("int")
    return files.withColumn("percent", F.when(F.col("done"), 100).otherwise(F.least(share, F.lit(99))))


def corpus_status(files: DataFrame, day: Column) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).withColumn("date", day).withColumn("status", F.when(F.col("files") > 0, "ok").otherwise("empty"))


def failures(log: DataFrame) -> DataFrame:
    kind = H.failure_kind(F.col("status"), F.col("error_name"), F.col("message"))
    return log.select(kind.alias("f")).groupBy(F.col("f.kind").alias("kind"), F.col("f.retryable").alias("retryable")).agg(F.count("*").alias("n"))
