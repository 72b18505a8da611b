"""Windowed aggregates over events, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def windowed_counts(events: DataFrame, lateness: str | None = "10 minutes", width: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, total; with lateness, state older than the watermark is dropped."""
    timed = events.withWatermark("ts", lateness) if lateness else events
    found = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the Parquet files that arrive in folder."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def new_chunks(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Chunks (chunk_id, text, at) of a stream, each id once inside the lateness."""
    return stream.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["chunk_id"])
