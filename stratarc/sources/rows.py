"""Capture rows of the JSON contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratarc.functions import headers as H

#: headers may be an object or its JSON text; offsets may be numbers or text: all are read as text first.
SCHEMA = "custom_id string, uri string, uuid string, rec_type string, archived_ts string, status string, content_type string, file_name string, byte_offset string, length string, headers string"


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(SCHEMA).json(path)
    return raw.select(
        "custom_id",
        "uri",
        "uuid",
        "rec_type",
        F.to_timestamp("archived_ts").alias("archived_ts"),
        F.col("status").try_cast("int").alias("status"),
        H.content_essence(F.col("content_type")).alias("content_type"),
        "file_name",
        F.col("byte_offset").try_cast("long").alias("byte_offset"),
        F.col("length").try_cast("long").alias("length"),
        H.header_text(F.col("headers")).alias("headers"),
    )
