"""Structured Streaming, beyond the reference: running verdicts over folders of records,
and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def record_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New JSON-lines files of a folder as they come."""
    return spark.readStream.schema(schema).json(folder)


def running_accuracy(records: DataFrame, bucket: str = "bucket") -> DataFrame:
    """(bucket, n, ea) so far; for the output modes complete and update."""
    score = F.avg(F.coalesce(F.col("ea").cast("double"), F.lit(0.0)))
    return records.groupBy(bucket).agg(F.count("*").alias("n"), F.round(score, 6).alias("ea"))


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by tumbling window and type; rows later than ``late`` are dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n) of runs of a user's events without a longer gap."""
    rows = events.withWatermark("ts", "2 hours") if events.isStreaming else events
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
