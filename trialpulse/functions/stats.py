"""Small statistics as columns and one-row aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import staged


def ratio(x: Column, n: Column) -> Column:
    """PRJ-14: x / n, with 1 for an n of 0 or less."""
    return x / F.greatest(n, F.lit(1))


def r10(x: Column) -> Column:
    """Ten decimals, exact halves up: what a threshold is compared with, so that summation order can't flip a row."""
    return F.round(x + F.lit(1e-13), 10)


def total(columns: list[Column]) -> Column:
    """The sum in the order given."""
    return reduce(lambda a, b: a + b, columns)


def one_row(df: DataFrame, *aggregates: Column) -> DataFrame:
    """A one-row aggregate, to be joined by broadcast: its size doesn't depend on the data."""
    return F.broadcast(df.agg(*aggregates))


#: Accuracy of the first pass of percentiles(): ranks are off by at most rows / ACCURACY.
ACCURACY = 10_000


def percentiles(df: DataFrame, **wanted: tuple[Column, float]) -> DataFrame:
    """One row with the exact percentile of each (column, share), null where there is no value. The first pass finds the range of each, the second keeps the distinct values of the ranges only."""
    eps = 4 / ACCURACY
    rows = df.select(*(x.alias(f"_x_{n}") for n, (x, _) in wanted.items()))

    def end(n: str, p: float, extreme) -> Column:
        x = F.col(f"_x_{n}")
        return F.when(F.count(x) > ACCURACY, F.percentile_approx(x, F.lit(min(1.0, max(0.0, p))), F.lit(ACCURACY))).otherwise(extreme(x))

    near = one_row(rows, *(e for n, (_, p) in wanted.items() for e in (end(n, p - eps, F.min).alias(f"_low_{n}"), end(n, p + eps, F.max).alias(f"_high_{n}"))))
    clipped = {n: F.when(F.col(f"_x_{n}").isNotNull(), F.greatest(F.col(f"_low_{n}"), F.least(F.col(f"_high_{n}"), F.col(f"_x_{n}")))) for n in wanted}
    return rows.crossJoin(near).agg(*(F.percentile(clipped[n], F.lit(p)).alias(n) for n, (_, p) in wanted.items()))


def zscore(x: Column, mean: Column, std: Column) -> Column:
    """0 where the column is constant or has one row."""
    return F.when(F.coalesce(std, F.lit(0.0)) == 0, F.lit(0.0)).otherwise((x - mean) / std)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def average_ranks(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """AGG-24: (by, column, rank) of the distinct values of each group, of which ``w`` rows hold each; ties share the mean of their places. Values are sorted in ranges, whose counts give every range its first place in each group: no task sorts a whole group."""
    distinct = values.groupBy(*by, column).agg(F.sum("w").alias("_n"))
    ranged = staged(distinct.repartitionByRange(_partitions(values), *by, column).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(*by, "_part").agg(F.sum("_n").alias("_all"))
    before = Window.partitionBy(*by).orderBy("_part")  # a row a range
    starts = sizes.select(*by, "_part", (F.sum("_all").over(before) - F.col("_all")).alias("_before"))
    inside = F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.join(starts, [*by, "_part"]).select(*by, column, (F.col("_before") + inside - F.col("_n") + (F.col("_n") + 1) / 2).alias("rank"))


def spearman(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, correlation): Spearman of the columns x and y in each group, NULL where one is constant. Equal pairs are counted first."""
    met = staged(pairs.groupBy(*by, "x", "y").agg(F.count("*").alias("w")), "pairs")
    ranked = met
    for c in ("x", "y"):
        ranked = ranked.join(average_ranks(met, c, by).withColumnRenamed("rank", f"r{c}"), [*by, c])
    return ranked.groupBy(*by).agg(F.sum("w").alias("n"), correlation("rx", "ry", F.col("w")).alias("correlation"))


def correlation(x: str, y: str, rows: Column | None = None) -> Column:
    """AGG-23: Pearson of two columns as an aggregate, ``rows`` of each; NULL where one is constant."""
    a, b, w = F.col(x).cast("double"), F.col(y).cast("double"), (F.lit(1.0) if rows is None else rows.cast("double"))
    n, sa, sb = F.sum(w), F.sum(w * a), F.sum(w * b)
    return F.try_divide(n * F.sum(w * a * b) - sa * sb, F.sqrt((n * F.sum(w * a * a) - sa * sa) * (n * F.sum(w * b * b) - sb * sb)))


def label(metric: str) -> str:
    """PRJ-15: a metric's name for people."""
    return metric.replace("_sum", "").replace("_count", "").replace("_", " ").title()


def numbered(rows: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Rows with ``number`` 0, 1, .. in order of ``key``, without sorting them in one task: ranges of the key are sorted apart, and their counts give each its first number."""
    ranged = rows.repartitionByRange(parts or _partitions(rows), key).withColumn("_part", F.spark_partition_id())
    ranged = staged(ranged, "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part")  # as many rows as ranges
    starts = F.broadcast(sizes.select("_part", (F.sum("_n").over(before) - F.col("_n")).alias("_before")))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return ranged.join(starts, "_part").withColumn("number", F.col("_before") + place).drop("_part", "_before")


def share_text(x: Column) -> Column:
    """A share as a percentage of one decimal."""
    return F.format_string("%.1f%%", F.round(r10(x * 100), 1))
