"""Calls and failures of a service by window of event time. Rows later than the watermark are dropped by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_health(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """events (ts, event_type, value): a row per window with calls, failures, mean and largest value; state is bounded by the watermark."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window))
    out = w.agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("failures"), F.avg("value").alias("mean"), F.max("value").alias("largest"))
    return out.select(F.col("window.start").alias("start"), "calls", "failures", "mean", "largest")
