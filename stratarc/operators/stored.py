"""Intermediate tables in the shared folder: lineage is cut where a loop would let plans grow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one would lose rows on a cluster, so there is none by default."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like stored(), dealt by the key into one file a bucket: joins on the key need no exchange of this side.

    Only tables of the session's catalog can be read by bucket, so it has one of this name.
    """
    spark = df.sparkSession
    label = f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).option("path", f"{shared_dir(spark)}/{label}").format("parquet").saveAsTable(label)
    return spark.table(label)
