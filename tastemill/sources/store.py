"""The store of runs, assignments and results: append-only Parquet, with views for what an update would change.

``at`` is a table's rows; every query is a plan over them. Null scores sort last.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ("dataset", "algo", "k", "preprocessing")


class Store:
    """Tables under one folder. Nothing is rewritten: a later row of an id replaces an earlier one in its view."""

    TABLES = {
        "runs": "id long, command string, dataset string, k long, scenario string, preprocessing string, note string, status string, at timestamp",
        "assignments": "id long, dataset string, algo string, k long, preprocessing string, run_id long, seed long, wcss double, gray_count long, gray_ratio double, n_users long, cluster_min long, cluster_max long, cluster_avg double, created_at timestamp",
        "wnmf_results": "assignment_id long, run_id long, scenario string, cv_fold long, mae double, rmse double, created_at timestamp",
        "labels": "assignment_id long, user_id long, cluster_id long, is_gray boolean, score double",
        "memberships": "assignment_id long, user_id long, cluster_id long, w double",
        "behaviour": "run_num long, algorithm string, final_wcss double, convergence_speed double, exploration_ratio double, category string",
    }

    #: Tables in a folder for each assignment: one assignment's rows are read alone.
    BY_ASSIGNMENT = ("labels", "memberships")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def exists(self, name: str) -> bool:
        try:
            return bool(self.spark.read.parquet(f"{self.root}/{name}").columns)
        except Exception as error:  # Spark says it in a class of its own for each store
            if "PATH_NOT_FOUND" in str(error):
                return False
            raise

    def read(self, name: str) -> DataFrame:
        if not self.exists(name):
            return self.spark.createDataFrame([], self.TABLES[name])
        rows = self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/{name}")
        return rows.withColumn("assignment_id", F.col("assignment_id").cast("long")) if name in self.BY_ASSIGNMENT else rows.drop("batch")

    def append(self, name: str, rows: DataFrame, assignment_id: int | None = None) -> None:
        """Adds rows in a folder of their own, so that writers never meet in one: the assignment's, or a new batch."""
        part = f"assignment_id={assignment_id}" if name in self.BY_ASSIGNMENT else f"batch={uuid.uuid4().hex}"
        rows.write.mode("append").parquet(f"{self.root}/{name}/{part}")

    def reserve(self, name: str) -> int:
        """A new id: the first whose file this writer is the one to create, so two writers never get the same."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.root}/_ids/{name}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        taken = [int(f.getPath().getName()) for f in fs.listStatus(folder)]
        new = max([last_id(self.read(name)), *taken]) + 1
        while not self.create_first(fs, hadoop.Path(folder, str(new))):
            new += 1
        return new

    @staticmethod
    def create_first(fs, path) -> bool:
        """Whether we created the file: atomic in stores that create so; of the local file system, whose Hadoop client is not, the operating system says it."""
        if fs.getScheme() != "file":
            return fs.createNewFile(path)
        try:
            os.close(os.open(path.toUri().getPath(), os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True

    def has_rows(self, name: str) -> bool:
        return not self.read(name).limit(1).isEmpty()

    def start_run(self, command: str, dataset: str, k: int, scenario: str = "", preprocessing: str = "", note: str = "") -> int:
        run = self.reserve("runs")
        row = self.spark.createDataFrame([(run, command, dataset, k, scenario, preprocessing, note, "running")], "id long, command string, dataset string, k long, scenario string, preprocessing string, note string, status string")
        self.append("runs", row.withColumn("at", F.current_timestamp()))
        return run

    def finish_run(self, run: int, status: str = "done") -> None:
        row = latest(self.read("runs"), "id", F.col("at")).where(F.col("id") == run)
        self.append("runs", row.withColumns({"status": F.lit(status), "at": F.current_timestamp()}))

    def save_assignment(self, labels: DataFrame, dataset: str, algo: str, k: int, preprocessing: str = "none", run_id: int | None = None, seed: int | None = None, wcss: float | None = None, members: DataFrame | None = None) -> int:
        """Labels (user_id, cluster_id, is_gray, score), memberships if there are any (vec_id or user_id, cluster_id, w), and one row of statistics; clusters without white users count for none. Returns the id."""
        new = self.reserve("assignments")
        self.append("labels", labels.select("user_id", "cluster_id", "is_gray", F.col("score").cast("double").alias("score")), new)
        if members is not None:
            user = F.col("user_id" if "user_id" in members.columns else "vec_id")
            self.append("memberships", members.select(user.cast("long").alias("user_id"), F.col("cluster_id").cast("long").alias("cluster_id"), "w"), new)
        per = labels.groupBy("cluster_id").agg(F.count("*").alias("n"), F.count_if("is_gray").alias("g"))
        white = F.when(F.col("n") > F.col("g"), F.col("n") - F.col("g"))
        out = per.agg(F.coalesce(F.sum("g"), F.lit(0)).alias("gray_count"), (F.sum("g") / F.sum("n")).alias("gray_ratio"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_users"), F.min(white).alias("cluster_min"), F.max(white).alias("cluster_max"), F.avg(white).alias("cluster_avg"))
        fixed = [("id", new, "long"), ("dataset", dataset, "string"), ("algo", algo, "string"), ("k", k, "long"), ("preprocessing", preprocessing, "string"), ("run_id", run_id, "long"), ("seed", seed, "long"), ("wcss", wcss, "double")]
        self.append("assignments", out.select(*[F.lit(v).cast(t).alias(c) for c, v, t in fixed], *out.columns, F.current_timestamp().alias("created_at")))
        return new

    def memberships(self, assignment_id: int) -> DataFrame:
        """user_id, cluster_id, w; no rows if none were saved."""
        return self.read("memberships").where(F.col("assignment_id") == assignment_id).drop("assignment_id")

    def labels(self, assignment_id: int) -> DataFrame:
        return self.read("labels").where(F.col("assignment_id") == assignment_id).drop("assignment_id")

    def save_result(self, dataset: str, algo: str, k: int, preprocessing: str, scenario: str, assignment_id: int | None = None, run_id: int | None = None, **metrics) -> int | None:
        """A result row of the given assignment, else of the best one of the key (none: null). Returns the id it was given."""
        if assignment_id is None:
            assignment_id = resolve_assignment(self.read("assignments"), dataset, algo, k, preprocessing)
        row = [("assignment_id", assignment_id, "long"), ("run_id", run_id, "long"), ("scenario", scenario, "string")]
        row += [(m, v, "string" if isinstance(v, str) else "long" if m in ("cv_fold", "n_train", "n_test") else "double") for m, v in metrics.items()]
        one = self.spark.range(1).select(*[F.lit(v).cast(t).alias(c) for c, v, t in row], F.current_timestamp().alias("created_at"))
        self.append("wnmf_results", one)
        return assignment_id

    def save_behaviour(self, rows: DataFrame) -> None:
        self.append("behaviour", rows.select(*[x.split()[0] for x in self.TABLES["behaviour"].split(", ")]))

    def create(self, recreate: bool = False) -> None:
        """Empty tables; those that hold rows are never replaced."""
        for name, schema in self.TABLES.items():
            if self.exists(name):
                if recreate and self.has_rows(name):
                    raise RuntimeError(f"{name} holds rows and stays as it is")
                continue
            self.append(name, self.spark.createDataFrame([], schema).drop("assignment_id") if name in self.BY_ASSIGNMENT else self.spark.createDataFrame([], schema), 0)

    def listing(self) -> str:
        """The assignments there are, by key, as text."""
        from tastemill.plans.reports import text_table

        return text_table(list_assignments(self.read("assignments")))

    def runs(self) -> DataFrame:
        return latest(self.read("runs"), "id", F.struct("at", (F.col("status") != "running")))


def last_id(df: DataFrame) -> int:
    return df.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]


def latest(df: DataFrame, key: str, order: Column) -> DataFrame:
    """Of each key the last row, by one aggregate."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def best_assignment(df: DataFrame) -> DataFrame:
    """Per key the assignment of least WCSS (ties: smaller id; without WCSS last)."""
    best = Window.partitionBy(*KEY).orderBy(F.asc_nulls_last("wcss"), "id")
    return df.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def load_assignment(df: DataFrame, strategy: str, run_id: int | None = None) -> DataFrame:
    if strategy == "best_wcss":
        return best_assignment(df)
    if strategy == "latest":
        order = Window.partitionBy(*KEY).orderBy(F.desc("created_at"), F.desc("id"))
    elif strategy == "by_run":
        df, order = df.where(F.col("run_id") == run_id), Window.partitionBy(*KEY).orderBy(F.desc("id"))
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def assignment_stats(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.min("wcss").alias("min_wcss"), F.max("wcss").alias("max_wcss"), F.avg("wcss").alias("avg_wcss"), F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run")
    )


def list_assignments(df: DataFrame, where: Column | None = None) -> DataFrame:
    """Per key its runs, least, largest and mean WCSS and last time, in order of data set, k, preprocessing and least WCSS."""
    df = df if where is None else df.where(where)
    out = df.groupBy(*KEY).agg(F.count("*").alias("n_runs"), F.min("wcss").alias("wcss_min"), F.max("wcss").alias("wcss_max"), F.avg("wcss").alias("wcss_avg"), F.max("created_at").alias("last_run"))
    return out.orderBy("dataset", "k", "preprocessing", F.asc_nulls_last("wcss_min"), "algo")


def resolve_assignment(df: DataFrame, dataset: str, algo: str, k: int, preprocessing: str) -> int | None:
    """The id of the best assignment of a key."""
    own = df.where((F.col("dataset") == dataset) & (F.col("algo") == algo) & (F.col("k") == k) & (F.col("preprocessing") == preprocessing))
    row = best_assignment(own).select("id").first()
    return row["id"] if row else None


def resolved(results: DataFrame, assignments: DataFrame) -> DataFrame:
    """Result rows by key with an assignment_id of their own or, where that is null, the best one of the key."""
    best = best_assignment(assignments).select(*KEY, F.col("id").alias("_best"))
    return results.join(best, list(KEY), "left").withColumn("assignment_id", F.coalesce("assignment_id", "_best")).drop("_best")


def prioritized(df: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per (dataset, algo, k) the best assignment of the first candidate preprocessing (preprocessing, ordinal) that has one."""
    met = best_assignment(df).join(F.broadcast(candidates), "preprocessing")
    first = Window.partitionBy("dataset", "algo", "k").orderBy("ordinal")
    return met.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def run_detail(results: DataFrame, assignments: DataFrame, run_id: int) -> DataFrame:
    met = results.where(F.col("run_id") == run_id).drop("run_id").join(assignments.select(F.col("id").alias("assignment_id"), "dataset", "algo", "k", "wcss"), "assignment_id")
    return met.orderBy(F.asc_nulls_last("mae"))


def last_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(n)


def missing_only(jobs: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Jobs that have no result yet."""
    return jobs.join(done.select(*on).distinct(), on, "left_anti")
