"""Aggregation of events over windows of time, the same for tables and streams. An extension: models have no time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, key: str, value: str, window: str, late: str = "10 minutes") -> DataFrame:
    """start, key, n, total by tumbling windows; of a stream, events later than `late` are left out."""
    events = events.withWatermark(time, late) if events.isStreaming else events
    out = events.groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """start, key, n by sessions: a key's events with less than a gap between them."""
    events = events.withWatermark(time, late) if events.isStreaming else events
    out = events.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), key, "n")
