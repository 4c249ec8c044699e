"""Stage tables in the folder that the cluster shares (spark.checkpoint.dir): they cut lineage and survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset and Spark is local, as in tests, a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="trialpulse-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once as Parquet and read back."""
    spark = df.sparkSession
    at = f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
