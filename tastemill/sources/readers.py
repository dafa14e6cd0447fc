"""Readers of rating, movie, user, assignment and result files.

Lines are split on executors; no file is parsed on the driver but small configs.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Genre names of the two movie files, in file order.
GENRES_1M = ["Action", "Adventure", "Animation", "Children's", "Comedy", "Crime", "Documentary", "Drama", "Fantasy", "Film-Noir", "Horror", "Musical", "Mystery", "Romance", "Sci-Fi", "Thriller", "War", "Western"]
#: Occupation names of the smaller user file.
OCCUPATIONS_100K = ["administrator", "artist", "doctor", "educator", "engineer", "entertainment", "executive", "healthcare", "homemaker", "lawyer", "librarian", "marketing", "none", "other", "programmer", "retired", "salesman", "scientist", "student", "technician", "writer"]


def lines(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Non-blank lines. Latin-1 is read as bytes, so no line is lost to its encoding."""
    raw = spark.read.option("encoding", encoding).option("header", False).option("sep", "\x01").option("quote", "").schema("value string").csv(path)
    return raw.where(F.trim("value") != "")


def read_ratings(spark: SparkSession, path: str, zero_based: bool = True) -> DataFrame:
    """``user::item::rating`` or tab separated; ``::`` wins; lines with fewer than three fields, or neither mark, are dropped."""
    text = lines(spark, path)
    parts = F.when(F.col("value").contains("::"), F.split("value", "::")).when(F.col("value").contains("\t"), F.split("value", "\t"))
    shift = 1 if zero_based else 0
    rows = text.select(parts.alias("p")).where(F.size("p") >= 3)
    stamp = F.when(F.size("p") >= 4, F.try_element_at("p", F.lit(4)).try_cast("long"))
    out = rows.select(
        (F.trim(F.col("p")[0]).try_cast("long") - shift).alias("user_id"), (F.trim(F.col("p")[1]).try_cast("long") - shift).alias("item_id"), F.trim(F.col("p")[2]).try_cast("double").alias("rating"), stamp.alias("ts")
    )
    return out.where("user_id IS NOT NULL AND item_id IS NOT NULL AND rating IS NOT NULL")


def read_ratings_100k(spark: SparkSession, folder: str, fold: int = 1) -> tuple[DataFrame, DataFrame]:
    """The predefined pair ``u{fold}.base`` and ``u{fold}.test``."""
    return read_ratings(spark, f"{folder}/u{fold}.base"), read_ratings(spark, f"{folder}/u{fold}.test")


def read_ratings_1m(spark: SparkSession, path: str, fold: int = 1, seed: str = "1m") -> tuple[DataFrame, DataFrame]:
    """Fold 1: a shuffled holdout of a fifth; folds 2 to 5: k-fold parts. Items get dense ids over both parts."""
    from tastemill.operators.prepare import dense_ids
    from tastemill.operators.splits import global_holdout, kfold

    whole = dense_ids(read_ratings(spark, path), "item_id")
    if fold == 1:
        cut = global_holdout(whole, 0.2, seed)
        return cut.where("NOT is_test").drop("is_test"), cut.where("is_test").drop("is_test")
    cut = kfold(whole, 5, seed)
    return cut.where(F.col("fold") != fold - 1).drop("fold"), cut.where(F.col("fold") == fold - 1).drop("fold")


def read_filmtrust(spark: SparkSession, path: str) -> DataFrame:
    """Any run of blanks, tabs or ``::`` separates; nothing is dropped silently for its separator."""
    rows = lines(spark, path).select(F.split(F.trim("value"), r"::|\s+").alias("p")).where(F.size("p") >= 3)
    return rows.select((F.col("p")[0].cast("long") - 1).alias("user_id"), (F.col("p")[1].cast("long") - 1).alias("item_id"), F.col("p")[2].cast("double").alias("rating"))


LOADERS: dict[str, Callable] = {"ml-100k": read_ratings_100k, "ml-1m": read_ratings_1m, "filmtrust": read_filmtrust}


def get_loader(name: str) -> Callable:
    try:
        return LOADERS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown data set: {name}") from None


def found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a wildcard, on whatever store they lie; none is an empty list."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [s.getPath().toString() for s in status] if status is not None else []


def first_existing(paths: list[str]) -> str:
    for p in paths:
        if found(SparkSession.active(), p):
            return p
    raise FileNotFoundError(", ".join(paths))


def load_dense(spark: SparkSession, candidates: list[str], reader: Callable = read_ratings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ratings of the first path that exists with dense ids, and the maps (user_id, dense) and (item_id, dense) from the file's ids."""
    from tastemill.operators.iterate import cut
    from tastemill.operators.prepare import id_map

    raw = reader(spark, first_existing(candidates)).select("user_id", "item_id", "rating")
    users, items = cut(id_map(raw, "user_id")), cut(id_map(raw, "item_id"))
    dense = raw.join(users.withColumnRenamed("dense", "_u"), "user_id").join(items.withColumnRenamed("dense", "_i"), "item_id")
    return dense.select(F.col("_u").alias("user_id"), F.col("_i").alias("item_id"), "rating"), users, items


def check_same_users(one: DataFrame, other: DataFrame) -> None:
    """Two results of an assignment have to be of the same users."""
    a, b = one.select("user_id").distinct(), other.select("user_id").distinct()
    odd = a.join(b, "user_id", "left_anti").limit(1).count() + b.join(a, "user_id", "left_anti").limit(1).count()
    if odd:
        raise ValueError("the tables are of different users")


def read_movies_1m(spark: SparkSession, path: str, n_items: int) -> DataFrame:
    """item_id and one 0/1 value for each genre; unknown genres are ignored, items out of range dropped."""
    rows = lines(spark, path).select(F.split("value", "::").alias("p")).where(F.size("p") >= 3)
    rows = rows.select((F.col("p")[0].cast("long") - 1).alias("item_id"), F.split(F.col("p")[2], r"\|").alias("g")).where(F.col("item_id").between(0, n_items - 1))
    return rows.select("item_id", F.array(*[F.array_contains("g", g).cast("int") for g in GENRES_1M]).alias("genres"))


def read_movies_100k(spark: SparkSession, path: str, n_items: int) -> DataFrame:
    """Fields 5 to 23 are flags (a line has at least 24 fields); a blank flag is 0."""
    rows = lines(spark, path).select(F.split("value", r"\|", -1).alias("p")).where(F.size("p") >= 24)
    rows = rows.select((F.col("p")[0].cast("long") - 1).alias("item_id"), F.slice("p", 6, 19).alias("f")).where(F.col("item_id").between(0, n_items - 1))
    return rows.select("item_id", F.transform("f", lambda x: F.coalesce(x.try_cast("int"), F.lit(0))).alias("genres"))


def one_hot(index, size: int):
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == index).cast("int"))


def read_users_1m(spark: SparkSession, path: str) -> DataFrame:
    rows = lines(spark, path).select(F.split("value", "::").alias("p")).where(F.size("p") >= 4)
    age = F.coalesce(F.trim(F.col("p")[2]).try_cast("double"), F.lit(25.0)) / 56
    job = F.greatest(F.lit(0), F.least(F.lit(20), F.coalesce(F.col("p")[3].try_cast("int"), F.lit(0))))
    return rows.select((F.col("p")[0].cast("long") - 1).alias("user_id"), (F.col("p")[1] == "M").cast("int").alias("male"), age.alias("age"), one_hot(job, 21).alias("occupation"))


def read_users_100k(spark: SparkSession, path: str) -> DataFrame:
    rows = lines(spark, path).select(F.split("value", r"\|").alias("p")).where(F.size("p") >= 4)
    names = F.array(*map(F.lit, OCCUPATIONS_100K))
    job = F.greatest(F.lit(0), F.array_position(names, F.lower(F.trim(F.col("p")[3]))).cast("int") - 1)
    return rows.select((F.col("p")[0].cast("long") - 1).alias("user_id"), (F.col("p")[2] == "M").cast("int").alias("male"), (F.col("p")[1].cast("double") / 100).alias("age"), one_hot(job, 21).alias("occupation"))


def read_assignments(spark: SparkSession, path: str, mask: DataFrame | None = None) -> DataFrame:
    """user_id, cluster_id, is_gray from CSV or Parquet; an explicit mask (user_id, is_gray) overrides the file's."""
    df = spark.read.csv(path, header=True) if path.endswith(".csv") else spark.read.parquet(path)
    user = "user_idx" if "user_idx" in df.columns else "user_id"
    own = F.col("is_gray_sheep").cast("boolean") if "is_gray_sheep" in df.columns else F.lit(False)
    out = df.select(F.col(user).cast("long").alias("user_id"), F.col("cluster_id").cast("long").alias("cluster_id"), F.coalesce(own, F.lit(False)).alias("is_gray"))
    if mask is None:
        return out
    return out.join(mask.select("user_id", F.col("is_gray").alias("_m")), "user_id", "left").select("user_id", "cluster_id", F.coalesce("_m", "is_gray").alias("is_gray"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, comment="#", inferSchema=True)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON of algorithm, segment and metric as rows (segment, metric, value)."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,double>>").alias("m"))
    return raw.select(F.explode("m").alias("segment", "inner")).select("segment", F.explode("inner").alias("metric", "value"))


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a file in any store; no more than a buffer of it is read."""
    java = spark._jvm.java.io
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = java.BufferedReader(java.InputStreamReader(file.getFileSystem(spark._jsc.hadoopConfiguration()).open(file), "UTF-8"))
    try:
        return reader.readLine() or ""
    finally:
        reader.close()


def read_runs(spark: SparkSession, root: str, name: str = "*.csv") -> DataFrame:
    """All runs under numbered folders, with run_num from the folder; columns that a run lacks are null, those of whole numbers or numbers throughout are typed so.

    Files of the same header are one read, by Spark's CSV reader, so quoted fields may hold commas, quotes and line breaks.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for path in found(spark, f"{root}/[0-9]*/{name}"):
        if re.search(r"/\d+/[^/]*$", path) and (line := first_line(spark, path).strip()):
            groups.setdefault(tuple(c.strip() for c in next(csv.reader([line]))), []).append(path)
    if not groups:
        raise FileNotFoundError(f"no numbered folder in {root}")
    parts = []
    for head, paths in groups.items():
        schema = ", ".join(f"`{c}` string" for c in head)
        rows = spark.read.csv(paths, schema=schema, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        parts.append(rows.select("*", F.regexp_extract("_metadata.file_path", r"/(\d+)/[^/]*$", 1).cast("int").alias("run_num")))
    columns = list(dict.fromkeys(c for head in groups for c in head))
    text = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    text = text.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in columns], "run_num")
    fits = lambda c, kind: F.coalesce(F.bool_and(F.col(c).try_cast(kind).isNotNull() | F.col(c).isNull()), F.lit(True)).alias(f"{kind} {c}")
    known = text.agg(*[fits(c, kind) for c in columns for kind in ("int", "double")]).first()
    kinds = {c: "int" if known[f"int {c}"] else "double" if known[f"double {c}"] else "string" for c in columns}
    return text.select(*[F.col(c).try_cast(kinds[c]).alias(c) for c in columns], "run_num")


def next_run_number(root: str, prefix: str = "") -> int:
    names = [p.rstrip("/").rsplit("/", 1)[1][len(prefix) :] for p in found(SparkSession.active(), f"{root}/{prefix}*")]
    return max((int(n) for n in names if n.isdigit()), default=0) + 1


def load_config(path: str | None, overrides: list[str] | None = None, defaults: dict | None = None) -> dict:
    """YAML over defaults, then ``section.key=value`` with the type of the value it replaces; no file: defaults."""
    import yaml

    config = {k: dict(v) if isinstance(v, dict) else v for k, v in (defaults or {}).items()}
    if path and Path(path).exists():
        for section, values in (yaml.safe_load(Path(path).read_text()) or {}).items():
            config[section] = {**config.get(section, {}), **values} if isinstance(values, dict) else values
    for item in overrides or []:
        name, value = item.split("=", 1)
        *way, last = name.split(".")
        at = config
        for step in way:
            at = at.setdefault(step, {})
        old, new = at.get(last), yaml.safe_load(value)
        if isinstance(old, bool):
            new = str(value).strip().lower() in ("1", "true", "yes", "on")
        elif isinstance(old, (int, float, str)) and not isinstance(new, (list, dict)):
            new = type(old)(value)
        at[last] = new
    return config
