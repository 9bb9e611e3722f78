"""Structured Streaming counterparts (beyond the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_values(events: DataFrame, ts: str = "ts", value: str = "value", late: str = "7 days") -> DataFrame:
    """Tumbling Monday-to-Sunday sums; rows later than ``late`` are left out."""
    week = F.window(ts, "7 days", startTime="4 days")
    return events.withWatermark(ts, late).groupBy(week).agg(F.sum(F.col(value).cast("decimal(18,6)")).cast("double").alias("value"), F.count("*").alias("events")).select(F.date_add(F.to_date("window.start"), 6).alias("week"), "value", "events")


def without_repeats(events: DataFrame, *keys: str, ts: str = "ts", within: str = "1 day") -> DataFrame:
    """Events whose keys were not seen within the watermark."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(list(keys))
