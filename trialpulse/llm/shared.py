"""Tables in the folder that the cluster shares: they cut lineage and survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset and Spark is local, as in tests, a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="trialpulse-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once and read back."""
    at = path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Keys that hold more than one row in this many are hot: there are at most as many of them.
HOT_SHARE = 10_000


def looked_up(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to the one row that ``facts`` has for each key; other rows drop out. Hot keys, at most HOT_SHARE of them whatever the data, are counted first and their facts broadcast; no task gets all rows of one. ``rows`` is read three times: stage it where that is dear."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_rows"))
    whole = counts.agg(F.sum("_rows").alias("_all"))
    hot = counts.crossJoin(F.broadcast(whole)).where((F.col("_rows") > 100) & (F.col("_rows") * HOT_SHARE > F.col("_all"))).select(key)
    hot = staged(hot, "hot")
    few = F.broadcast(facts.join(F.broadcast(hot), key))
    return rows.join(few, key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(facts, key))


def frugal(spark: SparkSession) -> None:
    """Texts reach Python 1000 rows at a time where the session keeps Spark's default of 10000: a worker then holds a few MB of them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, "1000")
