"""Streams: windowed counts with late data within a watermark, and results of every batch; subjects.py keeps metrics up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts, sums and means by key and window; rows later than the watermark drop out. Works on a stream and on a table."""
    source = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total", "mean")


def start(stream: DataFrame, score, to: str, checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    """foreachBatch: ``score`` of every batch is written under ``to``/batch=<id>; a batch that is run again overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{to}/batch={batch_id}")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
