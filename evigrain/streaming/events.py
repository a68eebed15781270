"""Structured Streaming over cost and crawl events: an extension, the batch queries' counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_costs(events: DataFrame, late: str = "1 hour", window: str = "1 day", slide: str | None = None) -> DataFrame:
    """Calls and seconds by kind in tumbling, or with ``slide`` sliding, windows; rows later than ``late`` are dropped."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return at.groupBy(span.alias("window"), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("seconds"))


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Runs of a user's events no farther apart than ``gap``."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return at.groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.count(F.lit(1)).alias("events"))


def first_seen(pages: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each ``(url, sha256)`` once within the watermark."""
    return pages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["url", "sha256"])
