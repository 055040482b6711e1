"""The captures of the test tables: one derived row per event, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratarc.operators.stored import stored


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


CAPTURES: dict[tuple[str, str], DataFrame] = {}


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived table, written once for a session and input."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in CAPTURES:
        CAPTURES[key] = stored(derived(spark, sf_dir), "captures")
    return CAPTURES[key]


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    n = F.lit(p.count())
    e, i, kind = events(spark, sf_dir), F.col("event_id"), F.col("event_type")
    rows = e.withColumn("pid", (i * 7 + F.col("user_id")) % n).withColumn("tid", (i * 11 + 3) % n)
    rows = rows.join(p.select(F.col("page_id").alias("pid"), F.col("url").alias("uri"), F.length("html").cast("long").alias("size")), "pid")
    rows = rows.join(p.select(F.col("page_id").alias("tid"), F.col("url").alias("to")), "tid")
    file_name = F.concat(F.lit("part-"), (i % 8).cast("string"), F.lit(".warc.gz"))
    uuid = F.md5(i.cast("string").cast("binary"))
    location = F.when(kind == "click", F.when(i % 5 == 0, "/moved").otherwise(F.col("to")))
    raw = F.element_at(F.array(*(F.lit(x) for x in ("text/html; charset=utf-8", "TEXT/HTML", "image/png", "text/css;charset=UTF-8", "application/javascript, text/javascript", None))), (i % 6 + 1).cast("int"))
    signup = kind == "signup"
    return rows.select(
        file_name.alias("file_name"),
        "uri",
        uuid.alias("uuid"),
        F.concat_ws("::", file_name, "uri", uuid).alias("custom_id"),
        F.when(signup, "revisit").when(kind == "purchase", "request").otherwise("response").alias("rec_type"),
        F.col("ts").alias("archived_ts"),
        F.when(kind == "view", 200).when(kind == "click", F.when(i % 2 == 0, 301).otherwise(302)).when(kind == "error", F.when(i % 3 == 0, 500).otherwise(404)).cast("int").alias("status"),
        location.alias("location"),
        F.when(kind.isin("view", "error"), F.col("size")).when((kind == "click") & (i % 4 != 0), F.lit(166).cast("long")).alias("payload_size"),
        F.when((kind == "purchase") | (signup & (i % 10 == 0)), None).otherwise(F.concat(F.lit("sha1:"), F.md5((F.col("pid") % 40).cast("string").cast("binary")))).alias("digest"),
        F.when(signup, F.col("uri")).alias("refers_to_uri"),
        F.when(signup, F.col("ts") - F.expr("INTERVAL 1 DAY")).alias("refers_to_date"),
        raw.alias("content_type_raw"),
        F.coalesce(F.lower(F.trim(F.split_part(raw, F.lit(";"), F.lit(1)))), F.lit("")).alias("content_type"),
        F.when(kind == "purchase", F.concat(F.lit("<urn:uuid:"), F.md5((i - 1).cast("string").cast("binary")), F.lit(">"))).alias("concurrent_to"),
        F.create_map(F.lit("Content-Type"), raw, F.when(i % 2 == 0, "location").otherwise("Location"), location).alias("headers"),
        (i * 1024).alias("byte_offset"),
        "event_id",
    )


def captures_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captures of files of which some were parsed twice."""
    c = captures(spark, sf_dir)
    return c.unionByName(c.where("event_id % 20 = 19"))


CAPTURES_SQL = """
np AS (SELECT count(*) AS n FROM pages),
cap_ids AS (SELECT events.*, (event_id * 7 + user_id) % n AS pid, (event_id * 11 + 3) % n AS tid FROM events, np),
cap_rows AS (SELECT c.*, p.url AS uri, CAST(length(p.html) AS BIGINT) AS size, t.url AS togo FROM cap_ids c JOIN pages p ON p.page_id = c.pid JOIN pages t ON t.page_id = c.tid),
captures AS (
  SELECT 'part-' || (event_id % 8) || '.warc.gz' AS file_name, uri, md5(CAST(event_id AS VARCHAR)) AS uuid,
    'part-' || (event_id % 8) || '.warc.gz::' || uri || '::' || md5(CAST(event_id AS VARCHAR)) AS custom_id,
    CASE event_type WHEN 'signup' THEN 'revisit' WHEN 'purchase' THEN 'request' ELSE 'response' END AS rec_type,
    ts AS archived_ts,
    CASE WHEN event_type = 'view' THEN 200 WHEN event_type = 'click' AND event_id % 2 = 0 THEN 301 WHEN event_type = 'click' THEN 302
         WHEN event_type = 'error' AND event_id % 3 = 0 THEN 500 WHEN event_type = 'error' THEN 404 END AS status,
    CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 5 = 0 THEN '/moved' ELSE togo END END AS location,
    CASE WHEN event_type IN ('view', 'error') THEN size WHEN event_type = 'click' AND event_id % 4 <> 0 THEN 166 END AS payload_size,
    CASE WHEN event_type = 'purchase' OR (event_type = 'signup' AND event_id % 10 = 0) THEN NULL ELSE 'sha1:' || md5(CAST(pid % 40 AS VARCHAR)) END AS digest,
    CASE WHEN event_type = 'signup' THEN uri END AS refers_to_uri,
    CASE WHEN event_type = 'signup' THEN ts - INTERVAL 1 DAY END AS refers_to_date,
    CASE event_id % 6 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'TEXT/HTML' WHEN 2 THEN 'image/png' WHEN 3 THEN 'text/css;charset=UTF-8' WHEN 4 THEN 'application/javascript, text/javascript' END AS content_type_raw,
    CASE WHEN event_type = 'purchase' THEN md5(CAST(event_id - 1 AS VARCHAR)) END AS concurrent_uuid,
    event_id * 1024 AS byte_offset, event_id
  FROM cap_rows
),
cap AS (
  SELECT *, coalesce(lower(trim(split_part(content_type_raw, ';', 1))), '') AS content_type,
    regexp_extract(uri, '^(https?://[^/?#]+)', 1) AS origin,
    regexp_extract(uri, '^https?://([^/?#]+)', 1) AS host,
    list_filter(string_split(regexp_extract(uri, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') AS segs,
    regexp_extract(uri, '[?]([^#]*)', 1) AS query,
    CASE WHEN status IN (301, 302, 303, 307, 308) THEN CASE WHEN location LIKE '/%' THEN regexp_extract(uri, '^(https?://[^/?#]+)', 1) || location ELSE location END END AS target
  FROM captures
),
raw AS (SELECT * FROM captures UNION ALL SELECT * FROM captures WHERE event_id % 20 = 19)"""
