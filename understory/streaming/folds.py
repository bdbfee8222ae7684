"""Streams of events: the same folds and windows as in batch, kept in state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

def fold(events: DataFrame, by: str = "user_id") -> DataFrame:
    """Running sum, count, bounds and flag of each key: partial aggregation takes the place of chunks."""
    v = F.col("value")
    return events.groupBy(by).agg(F.sum(v).alias("total"), F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.bool_or(F.col("event_type") == "error").alias("failed"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums by time window and type; with ``late``, state older than that is dropped."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size_h: int = 20, stride_h: int = 12) -> DataFrame:
    """Overlapping windows of which each event is owned by one: that whose middle is nearest, ties to the later.

    A window starts at every stride; it owns half a stride to each side of its middle.
    """
    hour = F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9
    first, last = F.ceil((hour - size_h) / stride_h), F.floor(hour / stride_h)
    owner = F.floor((hour - size_h / 2 + stride_h / 2) / stride_h)
    wide = events.withColumn("win", F.explode(F.sequence(first, last))).withColumn("owned", F.col("win") == owner)
    return wide.groupBy("win").agg(F.count("*").alias("context"), F.count_if("owned").alias("owned"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user."""
    s = events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def run_fold(spark: SparkSession, path: str, schema: str, checkpoint: str, table: str) -> DataFrame:
    """The fold over Parquet files as a stream, to completion; equal to the batch result over the same files."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = fold(stream).writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(table)
