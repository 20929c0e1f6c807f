"""Structured Streaming forms of event counts. An extension: batch inputs give the same results through the same functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def item_counts(events: DataFrame, width: str, late: str, time: str = "ts", item: str = "item") -> DataFrame:
    """window_start, item, n per tumbling window; rows later than the watermark are dropped."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.window(time, width).alias("w"), item).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), item, "n")


def user_sessions(events: DataFrame, gap: str, late: str, time: str = "ts", user: str = "user") -> DataFrame:
    """user, session_start, session_end, n: sessions that a gap ends."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def item_frequency(events: DataFrame, item: str = "item") -> DataFrame:
    """Running counts for the complete or update output mode."""
    return events.groupBy(item).agg(F.count("*").alias("freq"))
