"""The captures table: normalisation, dedup and per-URL dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratarc.functions import headers as H
from stratarc.functions import urls as U


def to_captures(wire: DataFrame) -> DataFrame:
    """The whole normalisation of parsed records, in one projection (input: the schema of the WARC source)."""
    warc = lambda name: H.header(F.col("warc"), name)
    http = lambda name: H.header(F.col("http"), name)
    uuid = H.record_uuid(warc("WARC-Record-ID"))
    url = F.coalesce(U.canonical_url(H.unwrap_angle(F.col("url"))), F.lit(""))
    return wire.select(
        uuid.alias("uuid"),
        url.alias("url"),
        F.coalesce(H.date_or_null(warc("WARC-Date")), F.timestamp_seconds(F.lit(0))).alias("archived_ts"),
        H.content_essence(http("Content-Type")).alias("content_type"),
        "file_name",
        H.custom_id(F.col("file_name"), url, uuid).alias("custom_id"),
        F.col("type").alias("rec_type"),
        F.col("offset").alias("byte_offset"),
        F.coalesce(H.number_or_null(warc("Content-Length")).cast("long"), F.lit(0).cast("long")).alias("length"),
        warc("WARC-IP-Address").alias("ip"),
        H.record_uuid(warc("WARC-Concurrent-To")).alias("concurrent_to"),
        H.record_uuid(warc("WARC-Refers-To")).alias("refers_to"),
        warc("WARC-Payload-Digest").alias("digest"),
        U.canonical_url(H.unwrap_angle(warc("WARC-Refers-To-Target-URI"))).alias("refers_to_uri"),
        H.date_or_null(warc("WARC-Refers-To-Date")).alias("refers_to_date"),
        warc("WARC-Truncated").alias("truncated"),
        F.when(
            F.col("http").isNotNull(),
            F.struct(
                F.col("version"),
                F.col("status"),
                F.col("status_text"),
                http("Location").alias("location"),
                H.content_type_full(http("Content-Type")).alias("content_type"),
                H.number_or_null(http("Content-Length")).cast("long").alias("content_length"),
                http("Content-Encoding").alias("content_encoding"),
                http("Transfer-Encoding").alias("transfer_encoding"),
                H.date_or_null(http("Last-Modified")).alias("last_modified"),
                F.col("http").alias("headers"),
            ),
        ).alias("http"),
        "payload",
    )


def first_per_id(captures: DataFrame, id_column: str = "custom_id") -> DataFrame:
    """One record per identity, the first by file and offset."""
    order = Window.partitionBy(id_column).orderBy("file_name", "byte_offset", "event_id") if "event_id" in captures.columns else Window.partitionBy(id_column).orderBy("file_name", "byte_offset")
    return captures.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def all_files(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def new_files(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Files not parsed yet; one is the same by name, modification time and size."""
    return listing.join(known, ["file_name", "modified", "size"], "left_anti")


def with_newest(captures: DataFrame, url: str = "uri", ts: str = "archived_ts") -> DataFrame:
    """The newest date of the URL on every row, over all record types; rows without a URL have none.

    An aggregate joined back, not a window: the sums are made before the exchange, and a URL with very many captures
    can be split over tasks.
    """
    newest = captures.where(F.col(url) != "").groupBy(F.col(url).alias("__url")).agg(F.max(ts).alias("last_archived_ts"))
    return captures.join(newest, F.col(url) == F.col("__url"), "left").drop("__url")


def totals(captures: DataFrame) -> DataFrame:
    return captures.agg(F.count("*").alias("records"), F.count_if(F.col("rec_type") == "response").alias("responses"))


def browsable(captures: DataFrame, url: str = "uri") -> DataFrame:
    return captures.where((F.col("rec_type") == "response") & (F.col(url) != ""))


def timeline_order() -> list[Column]:
    """Oldest first, ties by place in the file."""
    return [F.col("archived_ts").asc(), F.col("byte_offset").asc()]
