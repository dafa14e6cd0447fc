"""Reports: evaluation and comparison tables, text tables, a logger, and where results lie."""

from __future__ import annotations

import logging
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.sources.sinks import write_csv, write_json

EVALUATION = ("segment", "mae", "rmse", "precision", "recall", "n_predictions")


def write_evaluation(df: DataFrame, root: str) -> None:
    """A summary by segment as JSON and CSV; a missing metric is an empty cell."""
    rows = df.select(*EVALUATION)
    write_json(rows, f"{root}/evaluation_json")
    write_csv(rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in EVALUATION]), f"{root}/evaluation_csv")


def comparison(summaries: DataFrame, metrics: tuple[str, ...] = ("mae", "rmse", "precision", "recall")) -> DataFrame:
    """(algorithm, segment, metric, value) as a row for each algorithm and segment; a missing metric is empty text."""
    wide = summaries.groupBy("algorithm", "segment").pivot("metric", list(metrics)).agg(F.first("value"))
    return wide.select("algorithm", "segment", *[F.coalesce(F.col(m).cast("string"), F.lit("")).alias(m) for m in metrics])


def read_comparison(spark: SparkSession, path: str) -> DataFrame:
    """(algorithm, segment, metric, value) of summaries that lie as <algorithm>/<name>.json under ``path`` (a wildcard)."""
    raw = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("algorithm"), F.from_json("value", "map<string,map<string,double>>").alias("m"))
    return raw.select("algorithm", F.explode("m").alias("segment", "inner")).select("algorithm", "segment", F.explode("inner").alias("metric", "value"))


def write_comparison(summaries: DataFrame, path: str) -> None:
    write_csv(comparison(summaries), path)


def text_table(df: DataFrame, rows: int = 50) -> str:
    """The first rows as text with aligned columns."""
    found = df.limit(rows).collect()
    cells = [[("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r] for r in found]
    widths = [max([len(c), *(len(r[i]) for r in cells)]) for i, c in enumerate(df.columns)]
    line = lambda r: "  ".join(x.rjust(w) for x, w in zip(r, widths, strict=True))
    return "\n".join([line(df.columns), line(["-" * w for w in widths]), *map(line, cells)])


def logger(name: str = "tastemill", level: int = logging.INFO) -> logging.Logger:
    """One handler to stdout, however often it is asked for."""
    found = logging.getLogger(name)
    if not found.handlers:
        handler = logging.StreamHandler(sys.stdout)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        found.addHandler(handler)
    found.setLevel(level)
    return found


def result_paths(root: str, dataset: str, k: int | str = "*", cross_validated: bool = True) -> list[str]:
    """Wildcards of the result files of a data set and number of clusters: of means over folds, or of holdouts."""
    kind = "cv_mean" if cross_validated else "holdout"
    return [f"{root}/{dataset}/k={k}/{kind}/*.csv", f"{root}/run*/{dataset}/k={k}/{kind}/*.csv"]


def missing_tags(jobs: DataFrame, done: DataFrame | None) -> DataFrame:
    """Jobs (k, tag, svdpp) without a result row; a table without these columns has none."""
    key = ["k", "tag", "svdpp"]
    if done is None or not set(key) <= set(done.columns):
        return jobs
    return jobs.join(done.select(*key).distinct(), key, "left_anti")


def sync_suffix(suffix: str, latent: int) -> str:
    """The first ``_wnmf<digits>`` of a name gets the latent dimension."""
    return re.sub(r"_wnmf\d+", f"_wnmf{latent}", suffix, count=1)


def preprocessing_candidates(name: str) -> list[str]:
    """Spellings under which a preprocessing may be stored, the given one first, each once."""
    plain = name.strip().strip("_")
    short = re.sub(r"_(?:inmed|nndsvda?)_trim[0-9.]+_[0-9.]+", "", plain)
    return list(dict.fromkeys(x for x in (name, plain, plain.lower(), short, re.sub(r"_wnmf\d+", "", short)) if x))


def grid(**values: list) -> list[dict]:
    """All combinations of the lists, the last name varying fastest."""
    out: list[dict] = [{}]
    for name, options in values.items():
        out = [{**row, name: x} for row in out for x in options]
    return out


class Report:
    """Rows of results by algorithm, as a table."""

    SCHEMA = "algorithm string, metric string, value double"

    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, []

    def add(self, algorithm: str, **metrics: float) -> None:
        self.rows += [(algorithm, m, float(v)) for m, v in metrics.items()]

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, self.SCHEMA)

    def wide(self, *metrics: str) -> DataFrame:
        return self.table().groupBy("algorithm").pivot("metric", list(metrics)).agg(F.first("value")).orderBy("algorithm")
