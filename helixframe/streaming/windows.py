"""Extension: hourly windows over the events table, as a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly(events: DataFrame) -> DataFrame:
    """Count and sum by hour and type; on a stream, late rows beyond a day are dropped with their state."""
    # Watermarks are of instants; times without a zone are taken as the session's.
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day") if events.isStreaming else events
    out = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of events as they arrive in a folder."""
    return spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(folder)
