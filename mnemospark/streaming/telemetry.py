"""Structured Streaming forms of the telemetry reports over an `events`-like stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events, distinct users (approximate) and value by event-time window and type."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    out = w.agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("value"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "users", "value")


def first_sessions(recall: DataFrame, late: str = "2 days") -> DataFrame:
    """One row for each (memory, session) that passes the promotion gates, for a distinct count downstream."""
    good = recall.filter("session_id is not null and score >= 0.5 and rank <= 3").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return good.dropDuplicatesWithinWatermark(["memory_id", "session_id"]).select("memory_id", "session_id", "ts")
