"""The monitoring domain over the driver's tables: a subject spine and eight issue extracts, as narrow projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUTOFF = "2001-08-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a subject. Nation and region are dimension tables of fixed size (25 and 5 rows): broadcast."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    place = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    return c.join(F.broadcast(place), c.c_nationkey == F.col("n_nationkey"), "left").select(
        F.col("c_mktsegment").alias("study"),
        F.col("c_custkey").cast("string").alias("subject_id"),
        F.concat(F.lit("S"), F.col("c_nationkey"), F.lit("-"), F.col("c_custkey") % 2).alias("site_id"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("region"),
        F.when(F.col("c_acctbal") < 0, "Withdrawn").when(F.col("c_acctbal") < 1000, "").otherwise("Enrolled").alias("subject_status"),
        F.lit(None).cast("string").alias("latest_visit"),
    )


#: file type -> its columns, as facts() and extracts() give them.
COLUMNS = {
    "visit_tracker": ["days_outstanding"],
    "sae_dashboard": ["review_status"],
    "missing_lab": [],
    "missing_pages": ["days_missing"],
    "meddra_coding": ["coding_status"],
    "whodd_coding": ["coding_status"],
    "inactivated": [],
    "edrr": ["open_issues"],
}


def facts(spark: SparkSession, sf_dir: str, types: list[str] | None = None) -> DataFrame:
    """Rows of all file types (or of ``types``) in one table: file_type, study, subject_id and the columns of every type, NULL where a type has none. Orders and line items are filtered where they are read, line items once for six types; lines meet orders once, and what is left meets customers once."""
    c = F.col
    wanted = set(types or COLUMNS)

    def tag(rules: dict):
        # the rules exclude each other, so a row has one type
        out = None
        for name, rule in rules.items():
            if name in wanted:
                out = F.when(rule, name) if out is None else out.when(rule, name)
        return out

    of_orders = {
        "visit_tracker": (c("o_orderstatus") == "P") & (c("o_orderpriority") == "5-LOW") & (F.month("o_orderdate") == 1),
        "sae_dashboard": (c("o_orderpriority") == "1-URGENT") & (F.month("o_orderdate") == 2),
    }
    of_lines = {
        "missing_lab": (c("l_returnflag") == "R") & (c("l_quantity") >= 49) & (c("l_discount") >= 0.09),
        "missing_pages": (c("l_linestatus") == "O") & (c("l_returnflag") == "N") & (c("l_quantity") >= 48),
        "meddra_coding": (c("l_returnflag") == "A") & (c("l_quantity") >= 49) & (c("l_tax") >= 0.07),
        "whodd_coding": (c("l_returnflag") == "N") & (c("l_quantity") <= 2) & (c("l_tax") >= 0.07),
        "inactivated": (c("l_returnflag") == "R") & (c("l_linestatus") == "F") & (c("l_quantity") <= 1),
        "edrr": (c("l_returnflag") == "A") & (c("l_discount") <= 0) & (c("l_tax") <= 0),
    }
    parts, none = [], F.lit(None)
    orders = table(spark, sf_dir, "orders")

    def row(kind, days_outstanding=none, review_status=none, days_missing=none, coding_status=none, open_issues=none):
        return [c("o_custkey"), kind, days_outstanding.cast("int").alias("days_outstanding"), review_status.cast("string").alias("review_status"), days_missing.cast("int").alias("days_missing"), coding_status.cast("string").alias("coding_status"), open_issues.cast("string").alias("open_issues")]

    if wanted & set(of_orders):
        kind = tag(of_orders)
        visit, sae = c("file_type") == "visit_tracker", c("file_type") == "sae_dashboard"
        some = orders.select("o_custkey", "o_orderdate", "o_orderstatus", kind.alias("file_type")).where("file_type is not null")
        parts.append(some.select(*row(c("file_type"), days_outstanding=F.when(visit, F.datediff(F.lit(CUTOFF).cast("date"), "o_orderdate")), review_status=F.when(sae, F.when(c("o_orderstatus") == "F", "Review Completed").otherwise(c("o_orderstatus"))))))
    if wanted & set(of_lines):
        lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity", tag(of_lines).alias("file_type")).where("file_type is not null")
        met = lines.join(orders.select("o_orderkey", "o_custkey", "o_orderdate"), c("l_orderkey") == c("o_orderkey")).where((c("file_type") != "missing_pages") | (c("l_shipdate") < c("o_orderdate")))
        coding = F.when(c("file_type") == "meddra_coding", "UnCoded Term").when(c("file_type") == "whodd_coding", "Not Coded")
        parts.append(met.select(*row(c("file_type"), days_missing=F.when(c("file_type") == "missing_pages", F.datediff("o_orderdate", "l_shipdate")), coding_status=coding, open_issues=F.when(c("file_type") == "edrr", c("l_quantity").cast("int") % 4))))
    who = table(spark, sf_dir, "customer").select("c_custkey", c("c_mktsegment").alias("study"))
    rows = reduce(DataFrame.unionByName, parts).join(who, c("o_custkey") == c("c_custkey"))
    return rows.withColumn("subject_id", c("o_custkey").cast("string")).drop("o_custkey", "c_custkey")


def extracts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """file_type -> rows with study, subject_id and the type's columns; each one reads only what its type needs."""
    return {name: facts(spark, sf_dir, [name]).select("study", "subject_id", *columns) for name, columns in COLUMNS.items()}
