"""Structured Streaming variants of the event log and of expiring state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Event files as they come, under the schema of those that are there."""
    schema = spark.read.parquet(path).schema
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs an instant


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, event_type, n, total): tumbling windows; rows later than the watermark are dropped by Spark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))


def ttl_sessions(events: DataFrame, ttl: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, session, n): a user's state goes when nothing has come for ttl."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", ttl), "user_id").agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there into a memory table of that name (for tests and small reports)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
