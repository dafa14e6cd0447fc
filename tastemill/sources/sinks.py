"""Writers. Tables are Parquet, partitioned by what they are looked up by; reports are CSV or JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_assignments(df: DataFrame, root: str) -> None:
    df.write.mode("append").partitionBy("dataset", "algo", "k").parquet(f"{root}/assignments")


def write_csv(df: DataFrame, path: str, command: str | None = None) -> None:
    out = df.withColumn("command", F.lit(command)) if command else df
    out.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def append_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; columns in the order in which they first appear, missing values null."""
    return old.unionByName(new, allowMissingColumns=True)


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_recommendations(predictions: DataFrame, lists: DataFrame, manifest: DataFrame, root: str) -> None:
    predictions.write.mode("overwrite").parquet(f"{root}/predictions")
    lists.write.mode("overwrite").parquet(f"{root}/recommendations")
    write_json(manifest, f"{root}/manifest")


def write_phase(df: DataFrame, root: str) -> None:
    """All runs of a screening phase in one table; its successes and failures are partitions of it."""
    df.write.mode("append").partitionBy("success").parquet(f"{root}/phase")
