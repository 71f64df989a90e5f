"""Structured Streaming over the telemetry table: an extension, there is no stream to match.

Event time, watermark, duplicates by id within the watermark, tumbling counts and sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def deduplicated(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    return events.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["id"])


def windowed_counts(events: DataFrame, width: str = "5 minutes") -> DataFrame:
    grouped = events.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("total_ms"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "total_ms")


def session_counts(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    grouped = events.groupBy(F.session_window("at", gap), "actor_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("session_window.start").alias("start"), "actor_id", "n")


def append_to(df: DataFrame, path: str, checkpoint: str):
    """Exactly-once append of closed windows as Parquet; state and offsets live in checkpoint."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
