"""Windowed latency statistics over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_stats(metrics: DataFrame, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Count, sum, smallest, largest and mean duration by operation and window; late rows beyond the watermark are dropped. Exact percentiles need the batch form."""
    rows = metrics.withWatermark("timestamp", watermark).groupBy(F.window("timestamp", window), "operation")
    stats = rows.agg(F.count("duration").alias("count"), F.sum("duration").alias("total_time"), F.min("duration").alias("min_time"), F.max("duration").alias("max_time"), F.avg("duration").alias("avg_time"))
    return stats.select(F.col("window.start").alias("start"), "operation", "count", "total_time", "min_time", "max_time", "avg_time")
