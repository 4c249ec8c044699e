"""Raw-data diagnostics (AGG-27, AGG-28) and parameterised roll-ups (AGG-16)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import stats as S
from ..sources.discovery import id_match
from .master import present


def outliers(master: DataFrame, columns: list[str] = C.ISSUE_COLUMNS, multiplier: float = C.IQR_MULTIPLIER) -> DataFrame:
    """Values above Q3 + 3 IQR of every column's values above 0: how many, the largest, the p99. All columns in two aggregates."""
    x = {c: F.when(F.col(c) > 0, F.col(c).cast("double")) for c in columns}
    bounds = S.one_row(master, *(F.percentile(x[c], F.array(F.lit(0.25), F.lit(0.75))).alias(f"q_{c}") for c in columns))
    limit = {c: F.col(f"q_{c}")[1] + multiplier * (F.col(f"q_{c}")[1] - F.col(f"q_{c}")[0]) for c in columns}
    one = master.crossJoin(bounds).agg(F.array(*(F.struct(F.lit(c).alias("metric"), F.count_if(x[c] > limit[c]).alias("outliers"), F.max(x[c]).alias("largest"), S.r10(F.percentile(x[c], F.lit(0.99))).alias("p99")) for c in columns)).alias("all"))
    return one.select(F.explode("all").alias("m")).select("m.*")


def small_sites(master: DataFrame, least: int = 5) -> DataFrame:
    """Sites by whether they have fewer than ``least`` subjects."""
    sites = present(master, C.SITE_KEYS).groupBy(*C.SITE_KEYS).agg(F.count("*").alias("n"))
    return sites.agg(F.count("*").alias("sites"), F.count_if(F.col("n") < least).alias("small"), F.min("n").alias("fewest"), F.max("n").alias("most"))


def matches(spine: DataFrame, extracts: dict[str, DataFrame]) -> DataFrame:
    """Matched and unmatched ids of every extract."""
    return reduce(DataFrame.unionByName, [id_match(spine, df, name) for name, df in extracts.items()])


def presence(spine: DataFrame, extracts: dict[str, DataFrame]) -> DataFrame:
    """AGG-28: studies with and without rows of each file type; a metric of the latter is 0 because nothing was delivered."""
    rows = reduce(DataFrame.unionByName, [df.select("study", F.lit(name).alias("file_type")) for name, df in extracts.items()])
    have = rows.groupBy("file_type").agg(F.count_distinct("study").alias("with_data"), F.array_sort(F.collect_set("study")).alias("studies"))
    whole = S.one_row(spine, F.count_distinct("study").alias("_n"))
    return have.crossJoin(whole).select("file_type", "with_data", (F.col("_n") - F.col("with_data")).alias("without_data"), F.array_join("studies", ", ").alias("studies"))


def level_risk(site: DataFrame, keys: list[str], high: tuple[float, float] = (0.85, 0.05), medium: tuple[float, float] = (0.50, 0.02)) -> DataFrame:
    """AGG-16: any level over site rows with percentile thresholds and floors; twice the floors where nothing is above 0."""
    out = present(site, keys).groupBy(*keys).agg(F.count("*").alias("site_count"), F.sum("subject_count").alias("subject_count"), S.r10(F.avg("avg_dqi_score")).alias("avg_dqi_score"), F.sum("high_risk_count").alias("high_risk_subjects"))
    x = F.when(F.col("avg_dqi_score") > 0, F.col("avg_dqi_score"))
    found = S.percentiles(out, _high=(x, high[0]), _medium=(x, medium[0]))
    cuts = F.broadcast(found.select(*(F.when(F.col(n).isNull(), 2 * floor).otherwise(S.r10(F.greatest(F.col(n), F.lit(floor)))).alias(n) for n, (_, floor) in (("_high", high), ("_medium", medium)))))
    a = F.col("avg_dqi_score")
    return out.crossJoin(cuts).withColumn("risk_category", F.when(a >= F.col("_high"), "High").when(a >= F.col("_medium"), "Medium").otherwise("Low")).drop("_high", "_medium")
