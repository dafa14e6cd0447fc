"""Structured Streaming over rating events: windowed statistics and an incrementally kept user profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_feed(spark: SparkSession, folder: str, files_per_trigger: int = 10) -> DataFrame:
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.select("ts", "event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"), F.least(F.lit(5.0), 1 + F.floor(F.col("value") / 25)).cast("double").alias("rating"))


def item_windows(feed: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Ratings and mean by item and window; events later than ``late`` are dropped, and state with them."""
    return feed.withWatermark("ts", late).groupBy(F.window("ts", width), "item_id").agg(F.count("*").alias("n"), F.avg("rating").alias("mean")).select(F.col("window.start").alias("start"), "item_id", "n", "mean")


def distinct_events(feed: DataFrame, late: str = "1 hour") -> DataFrame:
    return feed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def user_sums(feed: DataFrame) -> DataFrame:
    """What a user profile needs, as sums that later batches add to."""
    r = F.col("rating")
    return feed.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(r).alias("s"), F.sum(r * r).alias("q"))


def profile(sums: DataFrame) -> DataFrame:
    mean = F.col("s") / F.col("n")
    return sums.select("user_id", "n", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("std"))


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Exactly-once append of finished windows as Parquet."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
