"""Structured Streaming over step logs (an extension: the batch engine's reductions on live logs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of Parquet files that arrive below ``path``; its event time is cast to a zoned timestamp, as watermarks need one."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame) -> DataFrame:
    """(window, event_type, n, total) of tumbling hours; on a stream with a watermark as on a table."""
    return events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def hourly_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The same of a stream; rows later than ``late`` are dropped, repeated events counted once."""
    return hourly(events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]))


def sessions_stream(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, user_id, n, total) of each user's sessions."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
