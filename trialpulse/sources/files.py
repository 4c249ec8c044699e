"""Flat files (SRC-16, SRC-17) and checks of what was read (PRJ-1, PRJ-2, PRJ-11, PRJ-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from .. import config as C


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder, on whatever file system the path names?"""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, optional: bool = False) -> DataFrame | None:
    """SRC-16: a CSV with header; types are inferred unless a schema is given (at scale give one: inferring reads the file twice). ``optional``: None where it is missing."""
    if optional and not exists(spark, path):
        return None
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")).csv(path)


def read_json(spark: SparkSession, path: str, optional: bool = False) -> DataFrame | None:
    """SRC-17: whole-file JSON documents, a row each."""
    return None if optional and not exists(spark, path) else spark.read.option("multiLine", "true").json(path)


def read_text(spark: SparkSession, path: str, optional: bool = False) -> DataFrame | None:
    """SRC-17: whole files as text, a row each."""
    return None if optional and not exists(spark, path) else spark.read.text(path, wholetext=True)


def missing_columns(df: DataFrame, required: list[str], strict: bool = False) -> list[str]:
    """PRJ-12: required columns that the table lacks; ``strict``: an error where there are any."""
    gone = [c for c in required if c not in df.columns]
    if gone and strict:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return gone


def value_issues(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]] | None = None, largest_day: int = C.MAX_DAYS) -> DataFrame:
    """PRJ-1, PRJ-2, PRJ-11: what cleaning changes, as rows (column, issue, n), in one aggregate: negative values of numeric columns, day counts beyond the cap, and values outside given ranges."""
    checks = []
    for field in df.schema:
        if isinstance(field.dataType, NumericType):
            x = F.col(field.name)
            checks.append((field.name, "negative values set to 0", x < 0))
            if "day" in field.name.lower():
                checks.append((field.name, f"values above {largest_day} capped", x > largest_day))
    for name, (low, high) in (ranges or {}).items():
        if low is not None:
            checks.append((name, f"values below {low}", F.col(name) < low))
        if high is not None:
            checks.append((name, f"values above {high}", F.col(name) > high))
    empty = df.sparkSession.createDataFrame([], "column string, issue string, n long")
    if not checks:
        return empty
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(i).alias("issue"), F.count_if(w).alias("n")) for c, i, w in checks))
    return df.agg(rows.alias("all")).select(F.explode("all").alias("r")).select("r.*").where("n > 0")


def clean(df: DataFrame, largest_day: int = C.MAX_DAYS) -> DataFrame:
    """PRJ-1, PRJ-2: negatives of numeric columns to 0, day columns to the cap; NULL stays."""
    out = {}
    for field in df.schema:
        if isinstance(field.dataType, NumericType):
            x = F.when(F.col(field.name) < 0, F.lit(0)).otherwise(F.col(field.name))
            if "day" in field.name.lower():
                x = F.when(F.col(field.name) > largest_day, F.lit(largest_day)).otherwise(x)
            out[field.name] = x.cast(field.dataType)
    return df.withColumns(out)
