"""Ledgers as streams: new request files drained to completion, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def drain(spark: SparkSession, source: str, schema: T.StructType, checkpoint: str, handle: Callable[[DataFrame, int], None], files_per_batch: int = 100) -> int:
    """Hand all request files that were not handled yet to ``handle`` in micro-batches, then stop; the checkpoint is the
    point to resume from. Returns the number of batches. ``handle`` may get a batch again after a crash."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(query.recentProgress)


def windowed_counts(events: DataFrame, time_col: str, key: str, window: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts per time window and key, batch or stream; rows later than ``late`` behind the newest are dropped by a
    stream. Times without zone are read as the session's zone, since a watermark needs an instant."""
    timed = events.withColumn("_at", F.col(time_col).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("_at", late)
    span = F.window("_at", window, slide) if slide else F.window("_at", window)
    return timed.groupBy(span.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n")
