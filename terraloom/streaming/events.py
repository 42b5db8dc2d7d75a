"""Folds over event logs, as batch jobs and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_key(events: DataFrame, keys: list[str]) -> DataFrame:
    """The last event of every key by (ts, event_id), and how many there were; a mergeable aggregate without a sort."""
    last = F.max(F.struct("ts", "event_id", "kind", "value")).alias("e")
    return events.groupBy(*keys).agg(last, F.count(F.lit(1)).alias("n")).select(*keys, F.col("e.event_id").alias("event_id"), F.col("e.kind").alias("kind"), F.col("e.value").alias("value"), "n")


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts per window and kind; runs as a batch job or, with the watermark, as a stream."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs a time with a zone
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "kind", "n", "total")
