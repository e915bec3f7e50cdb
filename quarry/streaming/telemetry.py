"""Event rollups, the same plan for batch and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def daily(events: DataFrame) -> DataFrame:
    """Counts and sums by day and type."""
    return events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and type; a stream drops what comes later than the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
