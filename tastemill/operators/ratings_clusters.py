"""Clusters over long-form ratings: masked distances, mk-means++ seeding, Lloyd's rounds, and what is asked of an assignment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.scalars import order_hash, r6, ratio
from tastemill.operators.iterate import cut
from tastemill.operators.neighbours import pair_similarity

#: Distance where a user and a centre have no item in common.
FAR = 1e9


def user_centres(ratings: DataFrame, chosen: list[int]) -> DataFrame:
    """cluster_id, item_id, value: the ratings of chosen users as centres, in their order."""
    order = F.create_map(*[F.lit(x) for i, u in enumerate(chosen) for x in (u, i)])
    return ratings.where(F.col("user_id").isin(chosen)).select(order[F.col("user_id")].cast("long").alias("cluster_id"), "item_id", F.col("rating").alias("value"))


def mean_centres(ratings: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean of all members, those without a rating of the item counting 0; cells of 0 are left out."""
    n = labels.groupBy("cluster_id").agg(F.count("*").alias("_n"))
    sums = ratings.join(labels, "user_id").groupBy("cluster_id", "item_id").agg(F.sum("rating").alias("_s"))
    return sums.join(n, "cluster_id").select("cluster_id", "item_id", (F.col("_s") / F.col("_n")).alias("value"))


def masked_distances(ratings: DataFrame, centres: DataFrame) -> DataFrame:
    """user_id, cluster_id, dist over the items that both have; pairs without one have no row."""
    d = F.col("rating") - F.col("value")
    return ratings.join(centres.where("value <> 0"), "item_id").groupBy("user_id", "cluster_id").agg(F.sqrt(F.sum(d * d)).alias("dist"))


def masked_labels(ratings: DataFrame, centres: DataFrame) -> DataFrame:
    """user_id, cluster_id of the nearest centre (ties: the first); users that share no item with any centre get the first."""
    first = F.min_by("cluster_id", F.struct(r6(F.col("dist")).alias("d"), F.col("cluster_id").alias("c")))
    near = masked_distances(ratings, centres).groupBy("user_id").agg(first.alias("cluster_id"))
    return ratings.select("user_id").distinct().join(near, "user_id", "left").select("user_id", F.coalesce("cluster_id", F.lit(0)).alias("cluster_id"))


def power_weights(ratings: DataFrame) -> DataFrame:
    """user_id, weight: Pearson with the most active user plus Pearson with the least active one (ties: smaller id); with oneself over all items."""
    n = ratings.groupBy("user_id").agg(F.count("*").alias("n"))
    ends = F.broadcast(n.agg(F.min_by("user_id", F.struct(-F.col("n"), "user_id")).alias("hi"), F.min_by("user_id", F.struct("n", "user_id")).alias("lo")))
    pairs = n.select("user_id").crossJoin(ends).select(F.col("user_id").alias("v"), F.explode(F.array("hi", "lo")).alias("u"))
    sims = pair_similarity(ratings, pairs.distinct(), "pearson_zero")
    return pairs.join(sims, ["u", "v"]).groupBy(F.col("v").alias("user_id")).agg(F.sum("sim").alias("weight"))


def seed_users(ratings: DataFrame, k: int, seed: str = "mk") -> list[int]:
    """k users as centres: first one of the largest weight (drawn by a hash of the id), then in proportion to squared masked distance, by exponential races.

    Users that share no item with a centre so far have distance 0; if all have, the draw is uniform.
    """
    users = ratings.select("user_id").distinct()
    n = users.count()
    if not 1 <= k <= n:
        raise ValueError(f"k must be in [1, {n}], not {k}")
    weights = power_weights(ratings).select("user_id", r6(F.col("weight")).alias("w"))
    top = weights.agg(F.max("w").alias("top"))
    first = weights.crossJoin(F.broadcast(top)).where("w = top").orderBy(order_hash("user_id", seed=f"{seed}0"), "user_id").first()["user_id"]
    chosen = [first]
    ratings = cut(ratings)
    while len(chosen) < k:
        u = (F.conv(F.substring(order_hash("user_id", seed=f"{seed}{len(chosen)}"), 1, 12), 16, 10).cast("double") + 1) / float((1 << 48) + 2)
        near = masked_distances(ratings, user_centres(ratings, chosen)).groupBy("user_id").agg(F.min("dist").alias("d"))
        left = users.where(~F.col("user_id").isin(chosen)).join(near, "user_id", "left").withColumn("w", F.coalesce(F.col("d") * F.col("d"), F.lit(0.0)))
        race = F.when(F.col("w") > 0, -F.log(u) / F.when(F.col("w") > 0, F.col("w")))
        chosen.append(left.orderBy(F.asc_nulls_last(race), -F.log(u), "user_id").first()["user_id"])
    return chosen


def lloyd(ratings: DataFrame, centres: DataFrame, k: int, rounds: int = 20, seed: str = "empty") -> tuple[DataFrame, DataFrame]:
    """(centres, labels) by masked distance; stops when no label changes. An empty cluster gets a user drawn by hash."""
    ratings, before, labels = cut(ratings), None, None
    for n in range(rounds):
        labels = cut(masked_labels(ratings, centres))
        mark = labels.agg(F.bit_xor(F.xxhash64("user_id", "cluster_id"))).first()[0]
        if mark == before:
            break
        before = mark
        used = {r["cluster_id"] for r in labels.select("cluster_id").distinct().collect()}  # at most k
        centres = mean_centres(ratings, labels)
        for c in sorted(set(range(k)) - used):
            user = labels.orderBy(order_hash("user_id", seed=f"{seed}{n}.{c}"), "user_id").first()["user_id"]
            centres = centres.unionByName(ratings.where(F.col("user_id") == user).select(F.lit(c).cast("long").alias("cluster_id"), "item_id", F.col("rating").alias("value")))
        centres = cut(centres)
    return centres, labels


def mk_means(ratings: DataFrame, k: int, rounds: int = 100, seed: str = "mk") -> tuple[DataFrame, DataFrame]:
    return lloyd(ratings, user_centres(ratings, seed_users(ratings, k, seed)), k, rounds, seed)


def mk_population(ratings: DataFrame, k: int, size: int, rounds: int = 100, seed: str = "mk") -> list[DataFrame]:
    """``size`` seedings, each with a seed of its own: starts for a population search."""
    if size <= 0:
        raise ValueError("size must be positive")
    return [mk_means(ratings, k, rounds, f"{seed}{i}.")[0] for i in range(size)]


@dataclass
class Assignment:
    """Labels (user_id, cluster_id) and, if known, is_gray of users; labels of k stand for gray users."""

    k: int
    labels: DataFrame | None = None
    centres: DataFrame | None = None
    has_mask: bool = False

    def fit(self, ratings: DataFrame, centres: DataFrame, metric: str = "pearson") -> Assignment:
        """Each user to the nearest centre: 1 - Pearson or Euclid, over the user's items; without any, the first."""
        from tastemill.operators.kernels import centroid_euclid, centroid_pearson

        d = (centroid_pearson if metric == "pearson" else centroid_euclid)(ratings, centres)
        first = F.min_by("cluster_id", F.struct(r6(F.col("dist")).alias("d"), F.col("cluster_id").alias("c")))
        near = d.groupBy("user_id").agg(first.alias("cluster_id"))
        every = ratings.select("user_id").distinct().join(near, "user_id", "left").select("user_id", F.coalesce("cluster_id", F.lit(0)).cast("long").alias("cluster_id"))
        self.labels, self.centres, self.has_mask = every.withColumn("is_gray", F.lit(False)), centres, False
        return self

    def load(self, labels: DataFrame, mask: DataFrame | None = None) -> Assignment:
        """Labels in 0..k, and a mask (user_id, is_gray) of exactly the same users."""
        n, low, high = labels.agg(F.count("*"), F.min("cluster_id"), F.max("cluster_id")).first()
        if not n:
            raise ValueError("no assignments")
        if low < 0 or high > self.k:
            raise ValueError(f"labels must be in [0, {self.k}]")
        rows = labels.select("user_id", "cluster_id")
        if mask is not None:
            odd = rows.join(mask.select("user_id", "is_gray"), "user_id", "full").where("cluster_id IS NULL OR is_gray IS NULL")
            if not odd.isEmpty():
                raise ValueError("mask and assignments are of different users")
            rows = rows.join(mask.select("user_id", "is_gray"), "user_id")
        else:
            rows = rows.withColumn("is_gray", F.lit(False))
        self.labels, self.has_mask = rows, True
        return self

    def _ready(self, mask: bool = False) -> DataFrame:
        if self.labels is None:
            raise RuntimeError("neither fitted nor loaded")
        if mask and not self.has_mask:
            raise RuntimeError("no gray mask is loaded")
        return self.labels

    def cluster_of(self, user_id: int) -> int:
        return self._ready().where(F.col("user_id") == user_id).first()["cluster_id"]

    def members(self, cluster_id: int) -> DataFrame:
        return self._ready().where(F.col("cluster_id") == cluster_id).select("user_id")

    def white_members(self, cluster_id: int) -> DataFrame:
        return self._ready(True).where((F.col("cluster_id") == cluster_id) & ~F.col("is_gray")).select("user_id")

    def gray_members(self, cluster_id: int) -> DataFrame:
        return self._ready(True).where((F.col("cluster_id") == cluster_id) & F.col("is_gray")).select("user_id")

    def sizes(self) -> DataFrame:
        """n of every label from 0 to k - 1, or to the largest there is."""
        labels = self._ready()
        top = labels.agg(F.greatest(F.max("cluster_id"), F.lit(self.k - 1)).alias("top"))
        every = top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("cluster_id"))
        return every.join(labels.groupBy("cluster_id").agg(F.count("*").alias("n")), "cluster_id", "left").na.fill(0, ["n"])

    def summary(self) -> DataFrame:
        gray = self._ready().agg(r6(F.avg(F.col("is_gray").cast("double"))).alias("gray_ratio"))
        out = self.sizes().agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), (F.floor(F.avg("n") * 10 + 0.5) / 10).cast("double").alias("mean"), F.sum((F.col("n") == 0).cast("long")).alias("empty"))
        return out.crossJoin(gray)


def white_sizes(assignment: DataFrame) -> DataFrame:
    """Smallest, largest and mean number of white users of clusters that have any."""
    per = assignment.where("NOT is_gray").groupBy("cluster_id").agg(F.count("*").alias("n"))
    return per.agg(F.min("n").alias("cluster_min"), F.max("n").alias("cluster_max"), r6(F.avg("n")).alias("cluster_avg"))


def gray_labels(labels: DataFrame, k: int) -> DataFrame:
    """Gray users get the label k."""
    return labels.withColumn("cluster_id", F.when(F.col("is_gray"), F.lit(k)).otherwise(F.col("cluster_id")).cast("long"))


def outlier_threshold(scored: DataFrame, limit: float = 1.5) -> DataFrame:
    """Gray count and ratio, and the middle between the largest factor of an inlier and the smallest of an outlier (where both exist)."""
    out = F.col("lof") > limit
    return scored.agg(
        F.sum(out.cast("long")).alias("gray_count"), r6(F.avg(out.cast("double"))).alias("gray_ratio"), r6((F.min(F.when(out, F.col("lof"))) + F.max(F.when(~out, F.col("lof")))) / 2).alias("threshold")
    )


def masked_wcss(ratings: DataFrame, centres: DataFrame, metric: str = "pearson") -> DataFrame:
    """Sum over users of the distance to the nearest centre."""
    from tastemill.operators.kernels import centroid_euclid, centroid_pearson

    d = (centroid_pearson if metric == "pearson" else centroid_euclid)(ratings, centres)
    return d.groupBy("user_id").agg(F.min("dist").alias("d")).agg(r6(F.sum("d")).alias("wcss"))


def pearson_silhouette(ratings: DataFrame, labels: DataFrame, n_sample: int = 200) -> DataFrame:
    """Silhouette by 1 - Pearson of a sample of users against all; pairs without two common items have distance 2."""
    users = labels.select("user_id", "cluster_id")
    sample = cut(users.orderBy(order_hash("user_id", seed="sil"), "user_id").limit(n_sample)).select(F.col("user_id").alias("u"), F.col("cluster_id").alias("own"))
    # the cells of the sample go to every task; all ratings of a user lie in one task, so the sums of a pair are made where it meets
    near = ratings.join(F.broadcast(sample), F.col("user_id") == F.col("u"), "left_semi").select(F.col("user_id").alias("u"), "item_id", F.col("rating").alias("x"))
    far = users.join(ratings, "user_id").select(F.col("user_id").alias("v"), "cluster_id", "item_id", F.col("rating").alias("y")).repartition("v")
    x, y, n = F.col("x"), F.col("y"), F.col("n")
    s = far.join(F.broadcast(near), "item_id").where("u <> v").groupBy("v", "cluster_id", "u").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"))
    sx, sy = F.col("sx"), F.col("sy")
    spread = (n * F.col("sxx") - sx * sx) * (n * F.col("syy") - sy * sy)
    sim = F.when((n >= 2) & (spread > 0), ratio(n * F.col("sxy") - sx * sy, F.sqrt(F.greatest(spread, F.lit(0.0))))).otherwise(-1.0)
    found = s.groupBy("u", "cluster_id").agg(F.sum(1 - sim).alias("_d"), F.count("*").alias("_met"))
    # members of a cluster that share no item with a user of the sample have distance 2
    members = users.groupBy("cluster_id").agg(F.count("*").alias("_all"))
    grid = F.broadcast(sample).crossJoin(members).withColumn("_all", F.col("_all") - (F.col("own") == F.col("cluster_id")).cast("long")).where("_all > 0")
    dist = grid.join(found, ["u", "cluster_id"], "left").na.fill(0, ["_d", "_met"]).select("u", "own", "cluster_id", ((F.col("_d") + 2 * (F.col("_all") - F.col("_met"))) / F.col("_all")).alias("m"))
    per = dist.groupBy("u").agg(F.max(F.when(F.col("own") == F.col("cluster_id"), F.col("m"))).alias("a"), F.min(F.when(F.col("own") != F.col("cluster_id"), F.col("m"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(ratio(F.col("b") - F.col("a"), F.greatest("a", "b"), 0.0, 1e-10))
    return per.agg(r6(F.coalesce(F.avg(s), F.lit(0.0))).alias("silhouette"))


def pearson_davies_bouldin(ratings: DataFrame, centres: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Davies-Bouldin by 1 - Pearson: S is the mean distance of members, 0 of empty clusters; centres meet over the items both have."""
    from tastemill.operators.kernels import centroid_pearson

    own = centroid_pearson(ratings, centres).join(labels.select("user_id", "cluster_id"), ["user_id", "cluster_id"]).groupBy("cluster_id").agg(F.avg("dist").alias("s"))
    every = centres.select("cluster_id").distinct().join(own, "cluster_id", "left").na.fill(0.0, ["s"])
    both = every.select(F.col("cluster_id").alias("u")).join(every.select(F.col("cluster_id").alias("v")), F.col("u") != F.col("v"))  # k rows each
    far = pair_similarity(centres.select(F.col("cluster_id").alias("user_id"), "item_id", F.col("value").alias("rating")), both, "pearson").select("u", "v", (1 - F.col("sim")).alias("m")).where("m >= 1e-10")
    met = far.join(every.select(F.col("cluster_id").alias("u"), F.col("s").alias("su")), "u").join(every.select(F.col("cluster_id").alias("v"), F.col("s").alias("sv")), "v")
    worst = met.groupBy("u").agg(F.max((F.col("su") + F.col("sv")) / F.col("m")).alias("w"))
    return worst.agg(r6(F.coalesce(F.sum("w"), F.lit(0.0)) / F.lit(k)).alias("davies_bouldin"))


def all_metrics(ratings: DataFrame, centres: DataFrame, labels: DataFrame, k: int, metric: str = "pearson") -> DataFrame:
    """One row: wcss, silhouette, davies_bouldin, and the size of the smallest and largest cluster and the number of empty ones."""
    from tastemill.operators.clusters import sizes

    s = sizes(labels, k).agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), F.sum((F.col("n") == 0).cast("long")).alias("empty"))
    return masked_wcss(ratings, centres, metric).crossJoin(pearson_silhouette(ratings, labels)).crossJoin(pearson_davies_bouldin(ratings, centres, labels, k)).crossJoin(s)


def top_pairs(pairs: DataFrame, k: int, value: str = "sim") -> DataFrame:
    """u, v, value: the k others of largest |value| of each user (ties: smaller id), instead of the table of all pairs."""
    from tastemill.operators.kernels import both_ways

    order = Window.partitionBy("u").orderBy(F.desc(F.abs(r6(F.col(value)))), "v")
    return both_ways(pairs, value).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
