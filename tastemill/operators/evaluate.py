"""Error and ranking metrics, by segment, cluster and fold. Empty sets give null."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.scalars import r6, ratio

ERROR = F.col


def error_columns():
    e = F.col("pred") - F.col("rating")
    return [F.count("*").alias("n"), r6(F.avg(F.abs(e))).alias("mae"), r6(F.sqrt(F.avg(e * e))).alias("rmse")]


def errors(scored: DataFrame) -> DataFrame:
    return scored.agg(*error_columns())


def errors_by_segment(scored: DataFrame, mask: DataFrame) -> DataFrame:
    """total, white and gray in one pass by grouping sets."""
    met = scored.join(mask.select("user_id", "is_gray"), "user_id")
    out = met.groupingSets([[], [F.col("is_gray")]], F.col("is_gray")).agg(F.grouping_id().alias("_g"), *error_columns())
    name = F.when(F.col("_g") == 1, "total").when(F.col("is_gray"), "gray").otherwise("white")
    return out.select(name.alias("segment"), "n", "mae", "rmse")


def binary_accuracy(scored: DataFrame, threshold: float = 4.0) -> DataFrame:
    return scored.agg(F.count("*").alias("n"), r6(F.avg(((F.col("rating") >= threshold) == (F.col("pred") >= threshold)).cast("double"))).alias("accuracy"))


def cluster_spread(scored: DataFrame, assignment: DataFrame) -> DataFrame:
    """Errors of each cluster, then mean, std, min and max over clusters."""
    per = scored.join(assignment.select("user_id", "cluster_id"), "user_id").groupBy("cluster_id").agg(*error_columns())
    out = [F.count("*").alias("clusters")]
    for m in ("mae", "rmse"):
        out += [r6(F.avg(m)).alias(f"{m}_mean"), r6(F.stddev_pop(m)).alias(f"{m}_std"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return per.agg(*out)


def ranking(lists: DataFrame, relevant: DataFrame, n: int) -> DataFrame:
    """Per user precision (of n), recall, F1 and NDCG of ranked lists (user_id, rank, item_id); users without relevant items are left out."""
    size = relevant.groupBy("user_id").agg(F.count("*").alias("rel"))
    hits = lists.where(F.col("rank") <= n).join(relevant.select("user_id", "item_id"), ["user_id", "item_id"])
    got = hits.groupBy("user_id").agg(F.count("*").alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    met = size.join(lists.select("user_id").distinct(), "user_id", "left_semi").join(got, "user_id", "left").na.fill(0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("rel"), F.lit(n)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    p, r = F.col("hits") / F.lit(float(n)), F.col("hits") / F.col("rel")
    return met.select("user_id", "hits", "rel", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), ratio(F.col("dcg"), ideal).alias("ndcg"))


def ranking_mean(per_user: DataFrame) -> DataFrame:
    return per_user.agg(F.count("*").alias("users"), *[r6(F.avg(m)).alias(m) for m in ("precision", "recall", "f1", "ndcg")])


def test_lists(scored: DataFrame) -> DataFrame:
    """Each user's test items ranked by prediction."""
    order = Window.partitionBy("user_id").orderBy(F.desc(r6(F.col("pred"))), "item_id")
    return scored.withColumn("rank", F.row_number().over(order)).select("user_id", "rank", "item_id")


def relevant_items(ratings: DataFrame, threshold: float = 4.0) -> DataFrame:
    return ratings.where(F.col("rating") >= threshold).select("user_id", "item_id")


def fold_errors(scored: DataFrame) -> DataFrame:
    return scored.groupBy("fold").agg(*error_columns())


def fold_summary(per_fold: DataFrame, metrics: tuple[str, ...] = ("mae", "rmse")) -> DataFrame:
    """metric, mean and population std over folds."""
    rows = per_fold.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("r")).select("r.*")
    return rows.groupBy("metric").agg(r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("std"))


def cross_validation_table(results: DataFrame, keys: list[str], more: tuple[str, ...] = (), text: bool = True) -> DataFrame:
    """Mean of mae, rmse and ``more`` metrics over folds (nulls and NaN skipped; only such: null), and the folds' errors as text in fold order."""
    clean = {m: F.nullif(F.nanvl(F.col(m).cast("double"), F.lit(None)), F.lit(None).cast("double")) for m in ("mae", "rmse", *more)}
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cv_fold", "mae"))), lambda s: F.format_string("%.2f", s["mae"])), ";")
    return results.groupBy(*keys).agg(F.count("*").alias("folds"), *[r6(F.avg(x)).alias(m) for m, x in clean.items()], *([line.alias("fold_mae")] if text else []))


def run_summary(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Means over runs if all succeeded; else success is false, metrics null and the errors joined."""
    ok = F.bool_and("success")
    errors_ = F.array_join(F.array_sort(F.collect_set("error")), "; ")
    return runs.groupBy(*keys).agg(ok.alias("success"), *[F.when(ok, r6(F.avg(m))).alias(m) for m in metrics], F.when(~ok, errors_).alias("error"))


def composite_rank(df: DataFrame, weights: dict[str, float], higher: tuple[str, ...] = ("silhouette",)) -> DataFrame:
    """Weighted min-max scores (lower is better but for ``higher``); a column without range, or all null, scores 0.5."""
    stats = df.agg(*[F.min(c).alias(f"{c}_lo") for c in weights], *[F.max(c).alias(f"{c}_hi") for c in weights])
    met = df.crossJoin(F.broadcast(stats))
    total = F.lit(0.0)
    for c, w in weights.items():
        lo, hi = F.col(f"{c}_lo"), F.col(f"{c}_hi")
        part = (F.col(c) - lo) if c in higher else (hi - F.col(c))
        total = total + F.lit(w) * F.when(hi > lo, ratio(part, hi - lo, 0.5)).otherwise(0.5)
    return met.select(*df.columns, r6(total).alias("score"))


def elbow(df: DataFrame) -> DataFrame:
    """(k, wcss, silhouette, mae): k of the largest single drop of WCSS, of the best silhouette and of the best MAE, and their mean."""
    d = df.withColumn("drop", F.lag("wcss").over(Window.orderBy("k")) - F.col("wcss"))
    out = d.agg(
        F.max_by("k", F.when(F.col("drop").isNotNull(), F.struct("drop", -F.col("k")))).alias("elbow_k"), F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("silhouette_k"), F.min_by("k", F.struct("mae", "k")).alias("mae_k")
    )
    return out.withColumn("suggested_k", F.bround((F.col("elbow_k") + F.col("silhouette_k") + F.col("mae_k")) / 3, 0).cast("long"))


def convergence(history: DataFrame) -> DataFrame:
    """(algorithm, epoch from 0, fitness): epoch that reaches 80 % of the gain, share gained after 70 % of epochs, category."""
    ends = history.groupBy("algorithm").agg(F.min_by("fitness", "epoch").alias("f0"), F.max_by("fitness", "epoch").alias("ft"), F.count("*").alias("epochs"))
    met = history.join(ends, "algorithm")
    late = F.when(F.col("epoch") == F.floor(F.col("epochs") * 0.7), F.col("fitness"))
    reached = F.when(F.col("fitness") <= F.col("f0") - 0.8 * (F.col("f0") - F.col("ft")), F.col("epoch"))
    out = met.groupBy("algorithm", "f0", "ft", "epochs").agg(F.min(reached).alias("speed"), F.max(late).alias("f70"))
    gain = F.col("f0") - F.col("ft")
    speed = F.when(F.col("epochs") < 2, 0).when(gain <= 0, F.col("epochs")).otherwise(F.col("speed"))
    share = F.when(F.col("epochs") < 10, 0.0).otherwise(ratio(F.col("f70") - F.col("ft"), gain))
    kind = F.when((speed <= 0.3 * F.col("epochs")) & (share < 0.1), "LOCAL").when((speed >= 0.6 * F.col("epochs")) & (share >= 0.2), "GLOBAL").otherwise("BALANCED")
    return out.select("algorithm", speed.cast("long").alias("convergence_speed"), r6(share).alias("exploration_ratio"), kind.alias("category"))
