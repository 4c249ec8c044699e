"""Subject metrics that a stream keeps (AGG-2..9 on a stream).

A fact is a row of an extract with an id and a version. A subject's state is its
facts in their latest versions, so corrections and withdrawals that come late,
twice or before what they correct change the metrics once, and any order of
micro-batches ends with the metrics of the table of latest versions. Facts that
no version renews for ``ttl`` are forgotten.

The state is Spark's (transformWithState, keyed by subject, in RocksDB); the rows
of a subject meet in one task, as many as it has facts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import config as C
from ..operators import master

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_VALUES = [T.StructField(m, T.DoubleType()) for m in C.ISSUE_COLUMNS]
OUTPUT = T.StructType([T.StructField("study", T.StringType()), T.StructField("subject_id", T.StringType()), *_VALUES])


class Facts(StatefulProcessor):
    """The facts of a subject, and its metrics whenever some arrive."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = T.StructType([T.StructField("fact_id", T.StringType())])
        self.facts = handle.getMapState("facts", key, T.StructType([T.StructField("version", T.LongType()), *_VALUES]), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for fact, version, gone, *values in pdf[["fact_id", "version", "withdrawn", *C.ISSUE_COLUMNS]].itertuples(index=False, name=None):
                new = (int(version), *(None if gone or pd.isna(v) else float(v) for v in values))
                old = self.facts.getValue((fact,)) if self.facts.containsKey((fact,)) else None
                if old is None or _order(tuple(old)) < _order(new):
                    self.facts.updateValue((fact,), new)
        columns: list[list[float]] = [[] for _ in C.ISSUE_COLUMNS]
        for _, state in self.facts.iterator():
            for column, v in zip(columns, tuple(state)[1:]):
                if v is not None:
                    column.append(v)
        got = [(max if m.startswith("max_days") else sum)(v) if v else None for m, v in zip(C.ISSUE_COLUMNS, columns)]
        yield pd.DataFrame([(*key, *got)], columns=OUTPUT.names).astype({m: "float64" for m in C.ISSUE_COLUMNS})

    def close(self) -> None:
        pass


def _order(state: tuple) -> tuple:
    """Later versions last; of one version, the larger values: the same whichever comes first."""
    return state[0], tuple(-1.0 if v is None else v for v in state[1:])


def metrics(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A row for every subject that a micro-batch touches, with its metrics after it. ``stream``: rows of projection.facts() with fact_id, version and withdrawn. Needs the RocksDB state store (PROVIDER)."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = master.contributions(stream, "fact_id", "version", F.coalesce("withdrawn", F.lit(False)).alias("withdrawn"))
    return rows.groupBy(*C.SUBJECT_KEYS).transformWithStateInPandas(statefulProcessor=Facts(ttl_ms), outputStructType=OUTPUT, outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None")


def latest(spark: SparkSession, at: str) -> DataFrame:
    """The metrics of every subject after the last batch that touched it, from what rescore.start() wrote; subjects of whose facts none counts are left out."""
    rows = spark.read.parquet(at)
    last = rows.groupBy(*C.SUBJECT_KEYS).agg(F.max_by(F.struct(*C.ISSUE_COLUMNS), "batch").alias("m")).select(*C.SUBJECT_KEYS, "m.*")
    return last.where(" or ".join(f"{m} is not null" for m in C.ISSUE_COLUMNS))
