"""Neighbour predictors driven by their targets, and what is built on them: routing of gray users, lists, evaluation.

A target (user, item) meets the members of the user's cluster who rated the item;
only these pairs of users get a similarity, also if they share no item (their
similarity is then the kernel's degenerate value). So the work follows the targets,
not the square of the users. Where the targets ask for as many raters as the clusters
have pairs of users, blocks of users meet instead (``blocks``) and no candidate is
shuffled. Targets are cells that the user has not rated in train.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.scalars import clip, r6, ratio
from tastemill.operators.evaluate import error_columns, ranking, ranking_mean, relevant_items, test_lists
from tastemill.operators import blocks as B
from tastemill.operators.iterate import cut
from tastemill.operators.kernels import BLOCK, finite, in_blocks
from tastemill.operators.predict import item_fallback_plain, top_n, user_means

Predictor = Callable[[DataFrame], DataFrame]


def candidates(train: DataFrame, targets: DataFrame, assignment: DataFrame, members: str = "all") -> DataFrame:
    """user_id, item_id, v, r_v: who of the user's cluster rated the item; ``white``: of these only users that are not gray.

    Raters of an item that very many of a cluster rated are dealt out in blocks, which its targets all visit, so no item is one task's work.
    """
    who = assignment if members == "all" else assignment.where("NOT is_gray")
    raters = train.join(who.select("user_id", "cluster_id"), "user_id").select("cluster_id", "item_id", F.col("user_id").alias("v"), F.col("rating").alias("r_v"))
    asked = targets.select("user_id", "item_id").join(assignment.select("user_id", "cluster_id"), "user_id")
    keys = ["cluster_id", "item_id"]
    raters, asked, keys = in_blocks(raters, asked, keys, "v", BLOCK)
    return asked.join(raters, keys).where("v <> user_id").select("user_id", "item_id", "v", "r_v")


def pair_similarity(train: DataFrame, pairs: DataFrame, kernel: str = "pearson") -> DataFrame:
    """u, v, sim of the given pairs over the items both rated.

    ``pearson``: means over the common items, not clipped, -1 with fewer than two of them or no variance.
    ``pearson_zero``: the same, clipped, but 0 in these cases.
    """
    x, y = F.col("x"), F.col("y")
    mine = pairs.join(train.select(F.col("user_id").alias("u"), "item_id", F.col("rating").alias("x")), "u")
    met = mine.join(train.select(F.col("user_id").alias("v"), "item_id", F.col("rating").alias("y")), ["v", "item_id"])
    s = met.groupBy("u", "v").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"))
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    spread = (n * F.col("sxx") - sx * sx) * (n * F.col("syy") - sy * sy)
    r = ratio(n * F.col("sxy") - sx * sy, F.sqrt(F.greatest(spread, F.lit(0.0))))
    if kernel == "pearson":
        low = -1.0
    elif kernel == "pearson_zero":
        r, low = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)), 0.0
    else:
        raise ValueError(f"unknown kernel: {kernel}")
    found = s.select("u", "v", F.when((n >= 2) & (spread > 0), r).otherwise(low).alias("sim"))
    return pairs.join(found, ["u", "v"], "left").select("u", "v", F.coalesce("sim", F.lit(low)).alias("sim"))


def moved_in_blocks(train: DataFrame, targets: DataFrame, assignment: DataFrame, kernel: str, k: int, members: str = "all", positive: bool = False, nonzero: bool = False) -> DataFrame | None:
    """``blocks.meet`` of the targets' users and the raters of their clusters; None if the targets ask for fewer raters than there are pairs of users."""
    own = assignment.select("user_id", "cluster_id", "is_gray") if members != "all" else assignment.select("user_id", "cluster_id")
    who = own if members == "all" else own.where("NOT is_gray")
    cells = train.join(who.select("user_id", F.col("cluster_id").alias("_g")), "user_id").select("_g", "user_id", "item_id", F.col("rating").alias("x"))
    asked = targets.select("user_id", "item_id").distinct().join(own.select("user_id", F.col("cluster_id").alias("_g")), "user_id")
    raters = cells.groupBy("_g", "item_id").agg(F.count("*").alias("_m"), finite(cells, "x").alias("_ok"))
    met = raters.join(asked.groupBy("_g", "item_id").agg(F.count("*").alias("_n")), ["_g", "item_id"], "full").groupBy("_g")
    stats = met.agg(F.sum(F.col("_m") * F.col("_n")).alias("_pairs"), F.sum("_n").alias("_cells"), F.coalesce(F.bool_and("_ok"), F.lit(True)).alias("_ok"))
    stats = stats.join(asked.groupBy("_g").agg(F.count_distinct("user_id").alias("_askers")), "_g").join(cells.groupBy("_g").agg(F.count_distinct("user_id").alias("_raters")), "_g")
    stats = cut(stats)
    pairs, most, n, ok = stats.agg(F.sum("_pairs"), F.sum(F.col("_askers") * F.col("_raters")), F.sum("_cells"), F.bool_and("_ok")).first()
    if not ok or (pairs or 0) < most:
        return None
    parts = cut(B.blocks_of(stats, int(n)))
    blocks = parts.agg(F.sum("_parts")).first()[0]
    mine = B.vectors(train.join(own.select("user_id", F.col("cluster_id").alias("_g")), "user_id").select("_g", "user_id", "item_id", F.col("rating").alias("x")))
    wanted = asked.groupBy("_g", "user_id").agg(F.collect_list(F.col("item_id").cast("long")).alias("asked")).join(mine, ["_g", "user_id"], "left").join(parts, "_g")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    wanted = wanted.select("_g", F.pmod(F.xxhash64("user_id"), F.col("_parts")).cast("int").alias("_t"), "user_id", empty("items", "array<long>"), empty("vals", "array<double>"), "asked")
    near = B.vectors(cells).join(parts, "_g").withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return B.meet(near, wanted, blocks, kernel, k, positive, nonzero)


def similar_users(ratings: DataFrame, k: int, kernel: str = "pearson_zero") -> DataFrame:
    """u, v, sim: the k others of largest |sim| of each user, of those that share an item (ties: smaller id), without a table of pairs."""
    from tastemill.operators.kernels import pair_sums, pearson_corated
    from tastemill.operators.ratings_clusters import top_pairs

    per = cut(ratings.groupBy("item_id").agg(F.count("*").alias("_m"), finite(ratings, "rating").alias("_ok")))
    pairs, ok = per.agg(F.sum(F.col("_m") * (F.col("_m") - 1)), F.bool_and("_ok")).first()
    users = ratings.select("user_id").distinct().count()
    if not ok or (pairs or 0) < users * (users - 1):
        return top_pairs(pearson_corated(pair_sums(ratings), -1.0 if kernel == "pearson" else 0.0, clip=kernel != "pearson"), k)
    # users of equal vectors have equal similarities: one of them asks for all, and of those asked the first k + 1 are enough (one may be the asking user)
    own = B.vectors(ratings.select(F.lit(0).alias("_g"), "user_id", "item_id", F.col("rating").alias("x")))
    cells = F.array_sort(F.arrays_zip("items", "vals"))
    own = own.withColumn("_d", F.sha2(F.to_json(cells), 256))
    for keys in (["_d", F.pmod(F.xxhash64("user_id"), F.lit(64))], ["_d"]):
        first = (own if keys[1:] else first).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("user_id"))).where(F.col("_n") <= k + 1)
    first = cut(first)
    one = first.where("_n = 1")
    users = one.count()
    n = max(min(B.TASKS, users // 64 + 1), users // B.USERS + 1)
    mine = one.select("_g", "user_id", "items", "vals", F.pmod(F.xxhash64("user_id"), F.lit(n)).cast("int").alias("_t"), F.lit(None).cast("array<long>").alias("asked"))
    near = first.select("_g", "user_id", "items", "vals", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_t"))
    best = B.meet(near, mine, n, kernel, k + 1, False, False, True).groupBy("user_id").agg(F.collect_list(F.struct((-F.abs(r6(F.col("up")))).alias("key"), F.col("item_id").alias("v"), F.col("up").alias("sim"))).alias("_b"))
    best = one.select("_d", "user_id").join(best, "user_id").select("_d", "_b")
    met = own.select("_d", F.col("user_id").alias("u")).join(best, "_d")
    others = F.slice(F.array_sort(F.filter("_b", lambda x: x["v"] != F.col("u"))), 1, k)
    return met.select("u", F.explode(others).alias("_o")).select("u", "_o.v", "_o.sim")


def knn(train: DataFrame, targets: DataFrame, assignment: DataFrame, kernel: str = "pearson", k: int = 30, members: str = "all", clipped: bool = True) -> DataFrame:
    """mean_u + sum s (r_v - mean_v) / sum |s| over the k candidates of largest |s| (ties: smaller id), else mean_u; a user without ratings has mean 0."""
    means = user_means(train)
    moved = moved_in_blocks(train, targets, assignment, kernel, k, members)
    if moved is None:
        moved = moved_by_target(train, targets, assignment, kernel, k, members)
    met = targets.join(moved.select("user_id", "item_id", F.col("up").alias("_up"), F.col("down").alias("_down")), ["user_id", "item_id"], "left").join(means, "user_id", "left")
    pred = F.coalesce("mean", F.lit(0.0)) + ratio(F.coalesce("_up", F.lit(0.0)), F.coalesce("_down", F.lit(0.0)), 0.0, 1e-10)
    return met.select(*targets.columns, (clip(pred) if clipped else pred).alias("pred"))


def moved_by_target(train: DataFrame, targets: DataFrame, assignment: DataFrame, kernel: str, k: int, members: str = "all") -> DataFrame:
    """user_id, item_id, up, down by a join of targets and raters."""
    near = candidates(train, targets, assignment, members)
    pairs = near.select(F.col("user_id").alias("u"), "v").distinct()
    sims = pair_similarity(train, pairs, kernel).withColumnRenamed("u", "user_id")
    top = Window.partitionBy("user_id", "item_id").orderBy(F.desc(F.abs(r6(F.col("sim")))), "v")
    kept = near.join(sims, ["user_id", "v"]).withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= k)
    return kept.join(user_means(train).toDF("v", "mean_v"), "v").groupBy("user_id", "item_id").agg(F.sum(F.col("sim") * (F.col("r_v") - F.col("mean_v"))).alias("up"), F.sum(F.abs("sim")).alias("down"))


def cluster_moved(train: DataFrame, targets: DataFrame, assignment: DataFrame, kernel: str, k: int, positive: bool = False) -> DataFrame | None:
    """up and down for ``predict.knn_centred`` and, ``positive``, ``predict.cluster_knn``: raters without similarity don't count."""
    return moved_in_blocks(train, targets, assignment, kernel, k, "all", positive, True)


def white(train, targets, assignment, kernel="pearson", k=30, clipped=False) -> DataFrame:
    """Neighbours among the cluster's users that are not gray."""
    return knn(train, targets, assignment, kernel, k, "white", clipped)


def gray_same(train, targets, assignment, kernel="pearson", k=30, clipped=False) -> DataFrame:
    """Neighbours among all users of the cluster, gray ones too."""
    return knn(train, targets, assignment, kernel, k, "all", clipped)


def routed(train: DataFrame, targets: DataFrame, assignment: DataFrame, gray: str = "same", kernel: str = "pearson", k: int = 30, clipped: bool = False) -> DataFrame:
    """Each target by the predictor of its user: white users by white neighbours; gray ones by the whole cluster (``same``) or the item's mean (``fallback``)."""
    mask = assignment.select("user_id", "is_gray")
    pale, dark = targets.join(mask.where("NOT is_gray"), "user_id", "left_semi"), targets.join(mask.where("is_gray"), "user_id", "left_semi")
    if gray == "same":
        other = gray_same(train, dark, assignment, kernel, k, clipped)
    elif gray == "fallback":
        other = item_fallback_plain(train, dark, clipped)
    else:
        raise ValueError(f"unknown gray strategy: {gray}")
    return white(train, pale, assignment, kernel, k, clipped).unionByName(other)


def unseen(train: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """user_id, item_id of all items that a user has not rated, never rated ones too: as many rows as the lists ask for, without a join of both.

    The item ids travel as one array; the caller bounds the users, as a full ranking scores every item for each.
    """
    every = F.broadcast(items.agg(F.array_sort(F.collect_set("item_id")).alias("_all")))
    own = users.select("user_id").distinct().join(train.select("user_id", "item_id"), "user_id", "left").groupBy("user_id").agg(F.collect_set("item_id").alias("_own"))
    return own.crossJoin(every).select("user_id", F.explode(F.array_except("_all", "_own")).alias("item_id"))


def recommend(train: DataFrame, users: DataFrame, items: DataFrame, predictor: Predictor, n: int = 10) -> DataFrame:
    """user_id, rank, item_id, pred: the n best unseen items by the predictor (ties: smaller item).

    A predictor that knows which cells differ from its fallback (it has ``lists``) scores only these; any other
    one scores every unseen item of the users.
    """
    if hasattr(predictor, "lists"):
        return predictor.lists(users, items, n)
    return top_n(predictor(unseen(train, users, items)), n)


def group_key(df: DataFrame, assignment: DataFrame) -> DataFrame:
    """``df`` with _k, the user's cluster as text (none: empty)."""
    own = assignment.select("user_id", F.col("cluster_id").cast("string").alias("_c"))
    return df.join(own, "user_id", "left").withColumn("_k", F.coalesce("_c", F.lit(""))).drop("_c")


@dataclass(frozen=True)
class Knn:
    """``knn`` as a predictor whose lists need no users x items table.

    An item that nobody of the user's cluster rated has the user's mean, whatever the item. So only the
    cluster's items are scored for a user, and of all others the smallest ids fill the list up.
    """

    train: DataFrame
    assignment: DataFrame
    kernel: str = "pearson"
    k: int = 30
    members: str = "all"
    clipped: bool = True

    def __call__(self, targets: DataFrame) -> DataFrame:
        return knn(self.train, targets, self.assignment, self.kernel, self.k, self.members, self.clipped)

    def lists(self, users: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
        n = max(1, n)
        asked = group_key(users.select("user_id").distinct(), self.assignment)
        own = asked.join(self.train.select("user_id", "item_id"), "user_id")
        who = self.assignment if self.members == "all" else self.assignment.where("NOT is_gray")
        known = items.select("item_id").distinct()
        rated = group_key(self.train.join(who.select("user_id"), "user_id", "left_semi").select("user_id", "item_id"), who).select("_k", "item_id").distinct()
        rated = cut(rated.join(known, "item_id", "left_semi"))
        cells = asked.join(rated, "_k").select("user_id", "item_id").join(own.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
        best = top_n(self(cells), n).select("user_id", "item_id", "pred")
        return top_n(best.unionByName(self.plain(asked, own, rated, known, n)), n)

    def plain(self, asked: DataFrame, own: DataFrame, rated: DataFrame, known: DataFrame, n: int) -> DataFrame:
        """user_id, item_id, pred: of the items that nobody of the cluster rated, n that the user has not, smallest ids first.

        A cluster's first m such items lie among the first m + (rated ones) of all, and a user needs n and as
        many more as own ones are among them: rows follow the lists and the ratings, not users x items.
        """
        from tastemill.operators.prepare import id_map

        missed = own.join(known, "item_id", "left_semi").join(rated, ["_k", "item_id"], "left_anti").groupBy("user_id").agg(F.count("*").alias("_m"))
        depth = asked.join(missed, "user_id", "left").select("user_id", "_k", (F.lit(n) + F.coalesce("_m", F.lit(0))).alias("_depth"))
        depth = cut(depth)
        groups = depth.groupBy("_k").agg(F.max("_depth").alias("_most")).join(rated.groupBy("_k").agg(F.count("*").alias("_r")), "_k", "left")
        first = groups.select("_k", "_most", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_most") + F.coalesce("_r", F.lit(0)) - 1)).alias("dense"))
        free = first.join(id_map(known, "item_id"), "dense").join(rated, ["_k", "item_id"], "left_anti")
        free = free.withColumn("_at", F.row_number().over(Window.partitionBy("_k").orderBy("item_id"))).where("_at <= _most").select("_k", "item_id", F.col("_at").cast("long").alias("_at"))
        wanted = depth.select("user_id", "_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_depth"))).alias("_at"))
        cells = wanted.join(free, ["_k", "_at"]).join(own.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
        pred = F.coalesce("mean", F.lit(0.0))
        return cells.join(user_means(self.train), "user_id", "left").select("user_id", "item_id", (clip(pred) if self.clipped else pred).alias("pred"))


@dataclass(frozen=True)
class ItemMeans:
    """``item_fallback_plain`` as a predictor: one ranking of the items serves all users, each as deep as n and the own ratings."""

    train: DataFrame
    clipped: bool = False

    def __call__(self, targets: DataFrame) -> DataFrame:
        return item_fallback_plain(self.train, targets, self.clipped)

    def lists(self, users: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
        n = max(1, n)
        asked, known = users.select("user_id").distinct(), items.select("item_id").distinct()
        means = self.train.groupBy("item_id").agg(F.avg("rating").alias("pred")).join(known, "item_id", "left_semi")
        means = cut(means.withColumn("pred", clip(F.col("pred")) if self.clipped else F.col("pred")))
        own = self.train.select("user_id", "item_id").join(asked, "user_id", "left_semi")
        depth = cut(asked.join(own.groupBy("user_id").agg(F.count("*").alias("_m")), "user_id", "left").select("user_id", (F.lit(n) + F.coalesce("_m", F.lit(0))).alias("_depth")))
        most = depth.agg(F.max("_depth")).first()[0] or 0
        order = [F.desc(r6(F.col("pred"))), F.col("item_id")]
        # no deeper than n and the longest list of ratings
        ranking_ = means.orderBy(*order).limit(most).withColumn("_at", F.row_number().over(Window.orderBy(*order)).cast("long"))
        wanted = depth.select("user_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_depth"))).alias("_at"))
        rated = wanted.join(ranking_, "_at").select("user_id", "item_id", "pred").join(own, ["user_id", "item_id"], "left_anti")
        # items without any rating have the user's mean: the n smallest ids are enough
        rest = [r["item_id"] for r in known.join(means.select("item_id"), "item_id", "left_anti").orderBy("item_id").limit(n).collect()]
        if not rest:
            return top_n(rated, n)
        mean = F.coalesce("mean", F.lit(0.0))
        plain = asked.join(user_means(self.train), "user_id", "left").select("user_id", F.explode(F.array(*[F.lit(x).cast(known.schema["item_id"].dataType) for x in rest])).alias("item_id"), (clip(mean) if self.clipped else mean).alias("pred"))
        return top_n(rated.unionByName(plain), n)


@dataclass(frozen=True)
class Routed:
    """``routed`` as a predictor: lists of white and of gray users by their own predictors; users that are in no assignment get none."""

    train: DataFrame
    assignment: DataFrame
    gray: str = "same"
    kernel: str = "pearson"
    k: int = 30
    clipped: bool = False

    def __call__(self, targets: DataFrame) -> DataFrame:
        return routed(self.train, targets, self.assignment, self.gray, self.kernel, self.k, self.clipped)

    def lists(self, users: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
        mask = self.assignment.select("user_id", "is_gray")
        pale, dark = users.join(mask.where("NOT is_gray"), "user_id", "left_semi"), users.join(mask.where("is_gray"), "user_id", "left_semi")
        one = Knn(self.train, self.assignment, self.kernel, self.k, "white", self.clipped)
        if self.gray not in ("same", "fallback"):
            raise ValueError(f"unknown gray strategy: {self.gray}")
        other = Knn(self.train, self.assignment, self.kernel, self.k, "all", self.clipped) if self.gray == "same" else ItemMeans(self.train, self.clipped)
        return one.lists(pale, items, n).unionByName(other.lists(dark, items, n))


def evaluate_cf(train: DataFrame, test: DataFrame, predictor: Predictor, items: DataFrame, n: int = 10, threshold: float = 3.5) -> DataFrame:
    """One row: n, mae, rmse of the test cells; users, precision and recall of the lists of users with a relevant test item (none: 0)."""
    relevant = relevant_items(test, threshold)
    lists = recommend(train, relevant.select("user_id").distinct(), items, predictor, n)
    per = ranking(lists, relevant, n).agg(F.count("*").alias("users"), *[r6(F.coalesce(F.avg(m), F.lit(0.0))).alias(m) for m in ("precision", "recall")])
    return predictor(test).agg(*error_columns()).crossJoin(per)


def evaluate_fold(train: DataFrame, test: DataFrame, predictor: Predictor, items: DataFrame, restore: Callable[[DataFrame, Column], Column], ns: tuple[int, ...] = (5, 10), threshold: float = 3.5) -> DataFrame:
    """metric, value of one fold: errors on the scale of the ratings, clipped (``restore`` gives a column of it), and lists of each length on the scale of the model.

    Train, test and predictions are on the model's scale; a test value is relevant if it reaches ``threshold`` there. Empty sets give 0.
    """
    done = predictor(test)
    back = done.select(clip(restore(done, F.col("rating"))).alias("rating"), clip(restore(done, F.col("pred"))).alias("pred"))
    e = F.col("pred") - F.col("rating")
    rows = back.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    relevant = relevant_items(test, threshold)
    lists = recommend(train, relevant.select("user_id").distinct(), items, predictor, max(ns))
    for n in ns:
        per = ranking(lists, relevant, n).agg(*[F.avg(m).alias(f"{m}@{n}") for m in ("precision", "recall", "f1", "ndcg")])
        rows = rows.crossJoin(per)
    pairs = [F.struct(F.lit(c).alias("metric"), r6(F.coalesce(F.col(f"`{c}`"), F.lit(0.0))).alias("value")) for c in rows.columns]
    return rows.select(F.explode(F.array(*pairs)).alias("_m")).select("_m.*")


def aggregate_folds(folds: DataFrame) -> DataFrame:
    """metric, mean and population std over folds (metric, value)."""
    return folds.groupBy("metric").agg(r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("std"))


def rating_errors(test: DataFrame, predictor: Predictor) -> DataFrame:
    """rating, pred of every test cell."""
    return predictor(test).select("rating", "pred")


def regression_errors(done: DataFrame) -> DataFrame:
    """n, mae, rmse of (rating, pred)."""
    return done.agg(*error_columns())


def ranking_of_rows(done: DataFrame, n: int = 10, threshold: float = 3.5) -> DataFrame:
    """Mean precision, recall, F1 and NDCG of rows (user_id, item_id, rating, pred): each user's rows ranked by prediction; users without a relevant one are left out."""
    return ranking_mean(ranking(test_lists(done), relevant_items(done, threshold), n))


#: Predictions and lists that an assignment leaves, and the segments that they are reported under.
PREDICTED = {"mixed": "mixed", "gray_same": "gray_same_formula", "gray_fallback": "gray_fallback"}
LISTED = {"white": "white", "gray_same": "gray_same_formula", "gray_fallback": "gray_fallback"}


def artifacts(train: DataFrame, test: DataFrame, assignment: DataFrame, items: DataFrame, n: int = 10, kernel: str = "pearson_zero", k: int = 30) -> tuple[DataFrame, DataFrame]:
    """(kind, user_id, item_id, rating, pred) of test cells and (kind, user_id, rank, item_id, pred) of lists, by white, gray_same and gray_fallback predictors; mixed takes gray users by their cluster."""
    gray = assignment.where("is_gray").select("user_id")
    dark = test.join(gray, "user_id", "left_semi")
    done = [("mixed", routed(train, test, assignment, "same", kernel, k, True)), ("gray_same", gray_same(train, dark, assignment, kernel, k, True)), ("gray_fallback", item_fallback_plain(train, dark, True))]
    pale = assignment.where("NOT is_gray").select("user_id")
    lists = [
        ("white", Knn(train, assignment, kernel, k, "white", True).lists(pale, items, n)),
        ("gray_same", Knn(train, assignment, kernel, k, "all", True).lists(gray, items, n)),
        ("gray_fallback", ItemMeans(train, True).lists(gray, items, n)),
    ]

    def stacked(parts: list[tuple[str, DataFrame]]) -> DataFrame:
        out = None
        for name, df in parts:
            one = df.select(F.lit(name).alias("kind"), *df.columns)
            out = one if out is None else out.unionByName(one)
        return out

    return stacked(done), stacked(lists)


def evaluate_artifacts(predictions: DataFrame, lists: DataFrame, test: DataFrame, n: int = 10, threshold: float = 3.5) -> DataFrame:
    """segment, mae, rmse, n_predictions, precision, recall: errors of each kind of prediction, and precision and recall of each kind of list over users who have a list and a relevant item."""

    def named(kinds: dict[str, str]) -> Column:
        return F.coalesce(*[F.when(F.col("kind") == a, b) for a, b in kinds.items()])

    e = F.col("pred") - F.col("rating")
    errors = predictions.groupBy(named(PREDICTED).alias("segment")).agg(r6(F.avg(F.abs(e))).alias("mae"), r6(F.sqrt(F.avg(e * e))).alias("rmse"), F.count("*").alias("n_predictions"))
    relevant = relevant_items(test, threshold)
    size = relevant.groupBy("user_id").agg(F.count("*").alias("rel"))
    hits = lists.where(F.col("rank") <= n).join(relevant, ["user_id", "item_id"]).groupBy("kind", "user_id").agg(F.count("*").alias("hits"))
    per = lists.select("kind", "user_id").distinct().join(size, "user_id").join(hits, ["kind", "user_id"], "left").na.fill(0, ["hits"])
    p = per.groupBy(named(LISTED).alias("segment")).agg(r6(F.avg(F.col("hits") / F.lit(float(max(n, 1))))).alias("precision"), r6(F.avg(F.col("hits") / F.col("rel"))).alias("recall"))
    return errors.join(p, "segment", "full").select("segment", "mae", "rmse", "n_predictions", "precision", "recall")


def label_of_profiles(asked: DataFrame, train: DataFrame, assignment: DataFrame) -> DataFrame:
    """id, cluster_id of whole profiles (id, item_id, rating): that of the train user with exactly these ratings (the smallest id); others get none.

    Profiles are compared as digests of their sorted cells, so no pair of users is looked at cell by cell.
    """

    def digest(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy(key).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("item_id", "rating")))), 256).alias("_d"))

    known = digest(train, "user_id").groupBy("_d").agg(F.min("user_id").alias("user_id")).join(assignment.select("user_id", "cluster_id"), "user_id")
    return digest(asked, "id").join(known.select("_d", "cluster_id"), "_d", "left").select("id", "cluster_id")


def gray_users(*lists: DataFrame) -> DataFrame:
    """The users of any of the lists, once."""
    out = lists[0].select("user_id")
    for df in lists[1:]:
        out = out.union(df.select("user_id"))
    return out.distinct()
