"""Reproducible holdouts, folds and samples: order by a hash of the ids, never a random generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.scalars import order_hash


def user_holdout(df: DataFrame, share: float = 0.2, seed: str = "s1") -> DataFrame:
    """is_test for max(1, floor(n * share)) ratings of each user; a user with one rating has no train row.

    A user's ratings are ranked in one window, so those of one user have to fit a task; there are no more than items.
    """
    order = Window.partitionBy("user_id").orderBy(order_hash("user_id", "item_id", seed=seed), "item_id")
    n = F.count("*").over(Window.partitionBy("user_id"))
    return df.withColumn("is_test", F.row_number().over(order) <= F.greatest(F.lit(1), F.floor(n * share))).select(*df.columns, "is_test")


def positions(df: DataFrame, seed: str) -> DataFrame:
    """Global 0-based position by hash, without a global sort in one task: ranks in hash buckets over sums of buckets."""
    spot = df.withColumn("_h", order_hash("user_id", "item_id", seed=seed)).withColumn("_b", F.substring("_h", 1, 3))
    inside = spot.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy("_h", "user_id", "item_id")))
    sums = spot.groupBy("_b").agg(F.count("*").alias("_c"))
    before = sums.select(F.col("_b").alias("_b2"), F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    met = inside.join(F.broadcast(before), F.col("_b") == F.col("_b2"))  # at most 4096 rows
    return met.select(*df.columns, (F.col("_o") + F.col("_n") - 1).cast("long").alias("position"))


def global_holdout(df: DataFrame, share: float = 0.2, seed: str = "s2") -> DataFrame:
    n = df.count()
    return positions(df, seed).withColumn("is_test", F.col("position") < int(n * share)).drop("position")


def kfold(df: DataFrame, k: int = 5, seed: str = "s3") -> DataFrame:
    return positions(df, seed).withColumn("fold", (F.col("position") % k).cast("long")).drop("position")


def tuning_slice(df: DataFrame, seed: str = "s5") -> DataFrame:
    """is_valid for clip(max(16, min(0.15 n, n - keep)), 1, n - 1) ratings, keep = max(16, n // min(100, n))."""
    n = df.count()
    keep = max(16, n // min(100, n)) if n else 0
    size = min(max(max(16, min(int(0.15 * n), n - keep)), 1), n - 1) if n > 1 else 0
    return positions(df, seed).withColumn("is_valid", F.col("position") < size).drop("position")


def sample_rows(df: DataFrame, key: str, n: int, seed: str = "s7") -> DataFrame:
    return df.orderBy(order_hash(key, seed=seed), key).limit(n)


def first_users(df: DataFrame, n: int = 100) -> DataFrame:
    return df.join(df.select("user_id").distinct().orderBy("user_id").limit(n), "user_id", "left_semi")


def by_cluster(df: DataFrame, assignment: DataFrame) -> DataFrame:
    """Rows with their cluster; gray users have none (cluster_id null)."""
    return df.join(assignment, "user_id").withColumn("cluster_id", F.when(~F.col("is_gray"), F.col("cluster_id")))


def large_clusters(train: DataFrame, test: DataFrame, least: int = 5) -> DataFrame:
    """Clusters with at least ``least`` train rows and any test row."""
    return train.groupBy("cluster_id").count().where(F.col("count") >= least).select("cluster_id").join(test.select("cluster_id").distinct(), "cluster_id", "left_semi")
