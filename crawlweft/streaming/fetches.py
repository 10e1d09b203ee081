"""Structured Streaming over fetch events: first sightings, windowed error rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need a timestamp with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def first_seen(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each URL once within the watermark (a frontier's membership test)."""
    return _timed(events).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id"])


def error_rates(events: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Per tumbling window: fetches, errors and their ratio."""
    w = _timed(events).withWatermark("ts", delay).groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return w.select(F.col("window.start").alias("start"), "n", "errors", (F.col("errors") / F.col("n")).alias("error_rate"))
