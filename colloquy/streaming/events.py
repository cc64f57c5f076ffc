"""Windows over event streams; the same functions take static and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _watermarked(events: DataFrame, lateness: str) -> DataFrame:
    return events.withWatermark("ts", lateness) if events.isStreaming else events


def tumbling_counts(events: DataFrame, size: str = "30 seconds", lateness: str = "10 minutes") -> DataFrame:
    """Events and values of each type in fixed windows."""
    w = _watermarked(events, lateness).groupBy(F.window("ts", size).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def staggered_counts(events: DataFrame, size: str = "30 seconds", offset: str = "15 seconds", lateness: str = "10 minutes") -> DataFrame:
    """The same on a grid shifted by ``offset``."""
    w = _watermarked(events, lateness).groupBy(F.window("ts", size, size, offset).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Stretches of activity of each user, apart by at least ``gap``."""
    s = _watermarked(events, lateness).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last")).select("user_id", F.col("w.start").alias("start"), "last", "n")
