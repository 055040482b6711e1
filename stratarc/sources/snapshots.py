"""Named readings, published by version and read with fallback."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTERS = "name string, version string, saved_at timestamp"


def publish(df: DataFrame, root: str, name: str, saved_at: str, healthy: bool = True) -> bool:
    """Write a reading if it has rows and is healthy.  Its pointer row comes last, so that none is seen half-written."""
    if not healthy or df.isEmpty():
        return False
    version = uuid.uuid4().hex
    df.write.parquet(f"{root}/{name}/{version}")
    row = df.sparkSession.createDataFrame([(name, version)], "name string, version string").withColumn("saved_at", F.lit(saved_at).cast("timestamp"))
    row.write.mode("append").parquet(f"{root}/_pointers")
    return True


def _pointers(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(POINTERS).parquet(f"{root}/_pointers")
    except AnalysisException:
        return spark.createDataFrame([], POINTERS)


def read_newest(spark: SparkSession, root: str, name: str, fallback: DataFrame | None = None, live: DataFrame | None = None) -> DataFrame | None:
    """The live reading; else the newest version, else the fallback, flagged stale with the time they were saved."""
    if live is not None and not live.isEmpty():
        return live.withColumn("stale", F.lit(False)).withColumn("saved_at", F.lit(None).cast("timestamp"))
    top = _pointers(spark, root).where(F.col("name") == name).agg(F.max_by("version", "saved_at").alias("version"), F.max("saved_at").alias("at")).first()
    found = spark.read.parquet(f"{root}/{name}/{top.version}") if top.version else fallback
    if found is None:
        return None
    stale = found.withColumn("stale", F.lit(True)).withColumn("saved_at", F.lit(top.at).cast("timestamp"))
    return stale.withColumn("status", F.lit("error")) if "status" in found.columns and name == "status" else stale
