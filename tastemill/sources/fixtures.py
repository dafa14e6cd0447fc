"""Rating, vector and store views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rating_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        F.least(F.lit(5.0), 1 + F.floor(F.col("value") / 25)).cast("double").alias("rating"),
        "ts",
        "event_id",
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tastemill.operators.prepare import latest_rating

    return latest_rating(rating_events(spark, sf_dir))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse ratings: what a customer bought of a part."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    bought = line.select("l_orderkey", "l_partkey", "l_quantity").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return bought.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id")).agg(F.max(F.ceil(F.col("l_quantity") / 10)).cast("double").alias("rating"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("cluster_id"))


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("dataset"),
        F.col("o_orderstatus").alias("algo"),
        (F.col("o_custkey") % 5).alias("k"),
        F.lit("none").alias("preprocessing"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("wcss"),
        F.col("o_custkey").alias("run_id"),
        F.col("o_orderdate").alias("created_at"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("assignment_id"),
        F.col("l_linenumber").cast("long").alias("cv_fold"),
        F.col("l_suppkey").alias("run_id"),
        F.col("l_returnflag").alias("scenario"),
        F.col("l_discount").alias("mae"),
        F.when(F.col("l_linenumber") != 2, F.col("l_tax")).alias("rmse"),
    )
