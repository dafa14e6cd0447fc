"""Rating predictors and top-N lists. Targets are (user_id, item_id, rating); neighbours come from the user's cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.scalars import clip, r6, ratio
from tastemill.operators.kernels import both_ways


def user_means(train: DataFrame) -> DataFrame:
    return train.groupBy("user_id").agg(F.avg("rating").alias("mean"))


def global_mean(train: DataFrame) -> DataFrame:
    return F.broadcast(train.agg(F.avg("rating").alias("mu")))


def cluster_item_means(train: DataFrame, assignment: DataFrame) -> DataFrame:
    return train.join(assignment.select("user_id", "cluster_id"), "user_id").groupBy("cluster_id", "item_id").agg(F.avg("rating").alias("pred"))


def cluster_average(train: DataFrame, targets: DataFrame, assignment: DataFrame) -> DataFrame:
    """Mean of the cluster for the item, else the global mean; clipped."""
    met = targets.join(assignment.select("user_id", "cluster_id"), "user_id").join(cluster_item_means(train, assignment), ["cluster_id", "item_id"], "left")
    return met.crossJoin(global_mean(train)).select(*targets.columns, clip(F.coalesce("pred", "mu")).alias("pred"))


def soft_cluster_average(train: DataFrame, targets: DataFrame, assignment: DataFrame, members: DataFrame) -> DataFrame:
    """Sum over clusters of membership (user_id, cluster_id, w) times the cluster's mean or the global one; clipped."""
    means = cluster_item_means(train, assignment)
    met = targets.join(members, "user_id").join(means, ["cluster_id", "item_id"], "left").crossJoin(global_mean(train))
    return met.groupBy(*targets.columns).agg(clip(F.sum(F.col("w") * F.coalesce("pred", "mu"))).alias("pred"))


def neighbours(train: DataFrame, targets: DataFrame, sims: DataFrame, k: int) -> DataFrame:
    """Per target the k neighbours of largest |sim| who rated the item (ties: smaller id)."""
    sims = both_ways(sims).where("sim <> 0")
    met = targets.join(sims, targets.user_id == sims.u).join(train.select(F.col("user_id").alias("v"), "item_id", F.col("rating").alias("r_v")), ["v", "item_id"])
    top = Window.partitionBy("user_id", "item_id").orderBy(F.desc(F.abs(r6(F.col("sim")))), "v")
    return met.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= k).drop("_n", "u")


def knn_centred(train: DataFrame, targets: DataFrame, sims: DataFrame, k: int = 10, clipped: bool = True) -> DataFrame:
    """mean_u + sum s (r_v - mean_v) / sum |s|; without neighbours the user's mean, then the global one."""
    near = neighbours(train, targets, sims, k).join(user_means(train).toDF("v", "mean_v"), "v")
    moved = near.groupBy("user_id", "item_id").agg(F.sum(F.col("sim") * (F.col("r_v") - F.col("mean_v"))).alias("up"), F.sum(F.abs("sim")).alias("down"))
    return centred_from(train, targets, moved, clipped)


def centred_from(train: DataFrame, targets: DataFrame, moved: DataFrame, clipped: bool = True) -> DataFrame:
    met = targets.join(moved, ["user_id", "item_id"], "left").join(user_means(train), "user_id", "left").crossJoin(global_mean(train))
    base = F.coalesce("mean", "mu")
    pred = base + ratio(F.coalesce("up", F.lit(0.0)), F.coalesce("down", F.lit(0.0)), 0.0, 1e-8)
    return met.select(*targets.columns, (clip(pred) if clipped else pred).alias("pred"))


def cluster_knn(train: DataFrame, targets: DataFrame, sims: DataFrame, k: int = 10) -> DataFrame:
    """Top k by |s| first, then negatives count 0: sum max(0, s) r / sum max(0, s); else the user's mean, unclipped."""
    near = neighbours(train, targets, sims, k)
    s = F.greatest(F.lit(0.0), F.col("sim"))
    return positive_from(train, targets, near.groupBy("user_id", "item_id").agg(F.sum(s * F.col("r_v")).alias("up"), F.sum(s).alias("down")))


def positive_from(train: DataFrame, targets: DataFrame, moved: DataFrame) -> DataFrame:
    met = targets.join(moved, ["user_id", "item_id"], "left").join(user_means(train), "user_id", "left").crossJoin(global_mean(train))
    pred = F.when(F.col("down") >= 1e-8, clip(ratio(F.col("up"), F.col("down"), 0.0))).otherwise(F.coalesce("mean", "mu"))
    return met.select(*targets.columns, pred.alias("pred"))


def within_clusters(train: DataFrame, targets: DataFrame, assignment: DataFrame, kernel: str = "global_mean", k: int = 10, positive: bool = False) -> DataFrame:
    """``knn_centred`` (``positive``: ``cluster_knn``) by similarities inside clusters: in blocks of users, or from the table of pairs where few share an item."""
    from tastemill.operators import kernels as K
    from tastemill.operators.neighbours import cluster_moved

    moved = cluster_moved(train, targets, assignment, kernel, k, positive)
    if moved is not None:
        return (positive_from if positive else centred_from)(train, targets, moved)
    sims = K.pearson_global_mean(train, within=assignment) if kernel == "global_mean" else K.cosine_corated(K.pair_sums(train, assignment))
    return (cluster_knn if positive else knn_centred)(train, targets, sims, k)


def item_fallback(train: DataFrame, targets: DataFrame) -> DataFrame:
    """Gray users: mean of the item, else of the user, else of all; clipped."""
    items = train.groupBy("item_id").agg(F.avg("rating").alias("item_mean"))
    met = targets.join(items, "item_id", "left").join(user_means(train), "user_id", "left").crossJoin(global_mean(train))
    return met.select(*targets.columns, clip(F.coalesce("item_mean", "mean", "mu")).alias("pred"))


def item_fallback_plain(train: DataFrame, targets: DataFrame, clipped: bool = False) -> DataFrame:
    """Mean of the item, else of the user, else 0."""
    items = train.groupBy("item_id").agg(F.avg("rating").alias("_item"))
    met = targets.join(items, "item_id", "left").join(user_means(train), "user_id", "left")
    pred = F.coalesce("_item", "mean", F.lit(0.0))
    return met.select(*targets.columns, (clip(pred) if clipped else pred).alias("pred"))


def routed(white: DataFrame, gray: DataFrame, mask: DataFrame) -> DataFrame:
    """Predictions of ``gray`` for masked users, of ``white`` for the others. Each branch sees only its own users."""
    return white.join(mask.where("NOT is_gray"), "user_id", "left_semi").unionByName(gray.join(mask.where("is_gray"), "user_id", "left_semi"))


def factor_prediction(targets: DataFrame, users: DataFrame, items: DataFrame, clipped: bool = True) -> DataFrame:
    """Dot product of (user_id, p) and (item_id, q)."""
    from tastemill.functions.scalars import dot

    x = dot(F.col("p"), F.col("q"))
    return targets.join(users, "user_id").join(items, "item_id").select(*targets.columns, (clip(x) if clipped else x).alias("pred"))


def top_n(scored: DataFrame, n: int = 10) -> DataFrame:
    """rank, item_id per user: prediction descending, ties by smaller item."""
    order = Window.partitionBy("user_id").orderBy(F.desc(r6(F.col("pred"))), "item_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, n)).select("user_id", F.col("rank").cast("long").alias("rank"), "item_id", r6(F.col("pred")).alias("pred"))


def top_n_unseen_by_cluster(train: DataFrame, assignment: DataFrame, n: int = 10) -> DataFrame:
    """Top n unseen items by the mean of the cluster.

    A user's list needs only the n + (own ratings) best items of the cluster, so
    each cluster's ranking is cut at n + its users' largest number of ratings
    before users and items meet: no users x items product.
    """
    means = cluster_item_means(train, assignment)
    mine = train.groupBy("user_id").agg(F.count("*").alias("own")).join(assignment.select("user_id", "cluster_id"), "user_id")
    depth = mine.groupBy("cluster_id").agg((F.max("own") + n).alias("depth"))
    order = Window.partitionBy("cluster_id").orderBy(F.desc(r6(F.col("pred"))), "item_id")
    ranked = means.withColumn("_n", F.row_number().over(order)).join(F.broadcast(depth), "cluster_id").where(F.col("_n") <= F.col("depth")).select("cluster_id", "item_id", "pred")
    scored = mine.select("user_id", "cluster_id").join(ranked, "cluster_id").join(train.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return top_n(scored, n)
