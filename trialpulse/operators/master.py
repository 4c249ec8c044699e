"""Subject table: extracts to metrics to one row a subject (PRJ-1..10, JN-1, AGG-1..11)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C


def number(column: Column) -> Column:
    """PRJ-6: text to double, anything else to NULL."""
    return column.try_cast("double")


def clamped_days(column: Column) -> Column:
    """PRJ-1 and PRJ-2: negatives to 0, impossible day counts to the cap; NULL stays."""
    x = number(column)
    return F.when(x < 0, 0.0).when(x > C.MAX_DAYS, float(C.MAX_DAYS)).otherwise(x)


def clamp(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """PRJ-11: numeric columns into ranges; NULL stays."""
    for name, (low, high) in ranges.items():
        c = F.col(name)
        out = c
        if low is not None:
            out = F.when(out < low, F.lit(low)).otherwise(out)
        if high is not None:
            out = F.when(out > high, F.lit(high)).otherwise(out)
        df = df.withColumn(name, out.cast(df.schema[name].dataType))
    return df


def uncoded(df: DataFrame) -> Column:
    """PRJ-9: is the row uncoded? Without the column, every row is; a NULL status isn't."""
    if "coding_status" not in df.columns:
        return F.lit(True)
    return F.coalesce(F.col("coding_status").rlike("(?i)uncoded|not coded"), F.lit(False))


def pending(df: DataFrame) -> Column:
    """PRJ-10: anything but a completed review, NULL included."""
    return ~F.col("review_status").eqNullSafe(F.lit("Review Completed")) if "review_status" in df.columns else F.lit(True)


def _rows(extracts: dict[str, DataFrame] | DataFrame) -> tuple[DataFrame, dict[str, set[str]]]:
    """Rows of all file types in one table, and the columns that each type has."""
    if isinstance(extracts, DataFrame):
        rows, has = extracts, {k: set(extracts.columns) for k in FILE_TYPES}
    else:
        unknown = set(extracts) - set(FILE_TYPES)
        if unknown:
            raise ValueError(f"unknown file type {sorted(unknown)}")
        has = {k: set(df.columns) for k, df in extracts.items()}
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.select("study", "subject_id", *(F.col(c).cast("string") for c in ("days_outstanding", "review_status", "days_missing", "coding_status", "open_issues") if c in has[k]), F.lit(k).alias("file_type")) for k, df in extracts.items()])
    return rows.withColumn("subject_id", F.trim("subject_id")).where("study is not null and subject_id is not null and subject_id <> ''"), has


def _values(rows: DataFrame, has: dict[str, set[str]]) -> list[Column]:
    """AGG-2..9: what a row adds to each metric of C.ISSUE_COLUMNS, NULL where it doesn't count."""
    one = F.lit(1.0)
    values: dict[str, Column] = {}

    def of(kind: str, metric: str, value: Column, when: Column | None = None) -> None:
        if kind in has:
            here = F.col("file_type") == kind
            values[metric] = F.when(here if when is None else here & when, value)

    def there(kind: str, column: str) -> bool:
        return column in has.get(kind, ())

    of("visit_tracker", "missing_visit_count", one)
    if there("visit_tracker", "days_outstanding"):
        of("visit_tracker", "max_days_outstanding", clamped_days(F.col("days_outstanding").cast("string")))
    of("missing_lab", "lab_issues_count", one)
    of("sae_dashboard", "sae_total_count", one)
    of("sae_dashboard", "sae_pending_count", one, pending(rows) if there("sae_dashboard", "review_status") else None)
    of("missing_pages", "missing_pages_count", one)
    if there("missing_pages", "days_missing"):
        of("missing_pages", "max_days_page_missing", clamped_days(F.col("days_missing").cast("string")))
    for kind, metric in (("meddra_coding", "uncoded_meddra_count"), ("whodd_coding", "uncoded_whodd_count")):
        of(kind, metric, one, uncoded(rows) if there(kind, "coding_status") else None)
    of("inactivated", "inactivated_forms_count", one)
    if there("edrr", "open_issues"):
        x = number(F.col("open_issues").cast("string"))
        of("edrr", "edrr_open_issues", F.coalesce(F.when(x < 0, 0.0).otherwise(F.floor(x).cast("double")), F.lit(0.0)))
    return [values.get(m, F.lit(None).cast("double")).cast("double").alias(m) for m in C.ISSUE_COLUMNS]


def combined(metric: str):
    """How a metric's values of one subject combine: days by max, counts by sum."""
    return F.max if metric.startswith("max_days") else F.sum


def contributions(extracts: DataFrame, *keep: str) -> DataFrame:
    """A row each: subject keys, the ``keep`` columns and what the row adds to every metric. Works on a stream and on a table."""
    rows, has = _rows(extracts)
    return rows.select(*C.SUBJECT_KEYS, *keep, *_values(rows, has))


def metrics(extracts: dict[str, DataFrame] | DataFrame) -> DataFrame:
    """AGG-2..9: one row a subject and one column a metric, by one aggregate. ``extracts``: file type -> rows, or one table of all types with a file_type column (a column that no row of a type has counts as absent there)."""
    rows, has = _rows(extracts)
    each = rows.select(*C.SUBJECT_KEYS, *_values(rows, has))
    # a subject with rows of which none counts has no metrics, as one without rows
    got = each.groupBy(*C.SUBJECT_KEYS).agg(*(combined(m)(m).alias(m) for m in C.ISSUE_COLUMNS))
    return got.where(reduce(lambda a, b: a | b, (F.col(m).isNotNull() for m in C.ISSUE_COLUMNS)))


FILE_TYPES = [k for k in C.FILE_PATTERNS if k != "edc_metrics"]


def fill_category(column: Column) -> Column:
    """PRJ-5: empty, NULL and 'nan' to Unknown, stripped."""
    t = F.trim(column)
    return F.when(t.isNull() | t.isin("", "nan", "None"), F.lit("Unknown")).otherwise(t)


def quartile_bounds(df: DataFrame, columns: list[str], multiplier: float = C.IQR_MULTIPLIER, method: str = "iqr") -> DataFrame:
    """PRJ-3 and PRJ-4: one row of <c>_low and <c>_high (NULL: leave the column). NULLs of the columns don't count."""
    if method not in ("iqr", "zscore"):
        raise ValueError(f"unknown method {method}")
    got = []
    for c in columns:
        x = F.col(c).cast("double")
        if method == "iqr":
            q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.75)))
            low, high, width = q[0], q[1], q[1] - q[0]
        else:
            low = high = F.avg(x)
            width = F.stddev_samp(x)
        got += [F.when(width > 0, F.greatest(F.lit(0.0), low - multiplier * width)).alias(f"{c}_low"), F.when(width > 0, high + multiplier * width).alias(f"{c}_high")]
    return df.agg(*got)


def cap_outliers(df: DataFrame, columns: list[str], **options) -> DataFrame:
    """Columns clipped to their bounds: one aggregate for all columns, one row broadcast."""
    out = df.crossJoin(F.broadcast(quartile_bounds(df, columns, **options)))
    for c in columns:
        x = F.col(c).cast("double")
        low, high = F.col(f"{c}_low"), F.col(f"{c}_high")
        out = out.withColumn(c, F.when(x < low, low).when(x > high, high).otherwise(x))
    return out.drop(*(f"{c}_{k}" for c in columns for k in ("low", "high")))


def master_subject(spine: DataFrame, extracts: dict[str, DataFrame] | DataFrame) -> DataFrame:
    """JN-1, PRJ-3, PRJ-5, PRJ-7, PRJ-8: spine rows (duplicates stay) with all metrics: one left join instead of eight."""
    people = spine.withColumn("subject_id", F.trim("subject_id"))
    joined = cap_outliers(people.join(metrics(extracts), C.SUBJECT_KEYS, "left"), C.CAPPED_COLUMNS)
    out = joined.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)).cast("bigint") for c in C.ISSUE_COLUMNS})
    out = out.withColumns({c: fill_category(F.col(c)) for c in ("country", "region", "subject_status")})
    return out.withColumn("total_uncoded_count", F.col("uncoded_meddra_count") + F.col("uncoded_whodd_count"))


def present(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are all there: grouping drops the others. An empty site is a missing one."""
    for k in keys:
        df = df.where(F.col(k).isNotNull() & (F.col(k) != ""))
    return df


def master_site(master: DataFrame) -> DataFrame:
    """AGG-10."""
    sums = [c for c in C.ISSUE_COLUMNS if not c.startswith("max_days")]
    return present(master, C.SITE_KEYS).groupBy(*C.SITE_KEYS).agg(F.count("*").alias("subject_count"), *(F.sum(c).alias(c) for c in sums))


def master_study(master: DataFrame) -> DataFrame:
    """AGG-11."""
    sums = [c for c in C.ISSUE_COLUMNS if not c.startswith("max_days")]
    return present(master, ["study"]).groupBy("study").agg(F.count("*").alias("subject_count"), F.count_distinct("site_id").alias("site_count"), *(F.sum(c).alias(c) for c in sums))


def duplicates(master: DataFrame, keys: list[str] = C.SUBJECT_KEYS) -> DataFrame:
    """PRJ-19: all rows whose key occurs more than once."""
    many = master.groupBy(*keys).count().where("count > 1").drop("count")
    return master.join(many, keys, "left_semi").orderBy(*keys)
