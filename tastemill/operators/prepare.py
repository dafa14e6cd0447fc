"""Ids, duplicates, pruning, normalization, biases and profiles of long-form ratings (user_id, item_id, rating)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.scalars import ratio


def latest_rating(events: DataFrame) -> DataFrame:
    """Of several ratings of a cell the last by (ts, event_id)."""
    return events.groupBy("user_id", "item_id").agg(F.max_by("rating", F.struct("ts", "event_id")).alias("rating"))


def mean_rating(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "item_id").agg(F.avg("rating").alias("rating"))


def id_map(df: DataFrame, name: str) -> DataFrame:
    """Old id and its dense position by sorted distinct id.

    Positions come from ranks inside range partitions on top of the sizes of the
    partitions before, so no single task sorts all ids. The partition of an id is
    fixed by a checkpoint before it is used twice.
    """
    from tastemill.operators.iterate import cut

    ids = cut(df.select(name).distinct().repartitionByRange(name).select(name, F.spark_partition_id().alias("_p")))
    inside = ids.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(name)))
    sizes = ids.groupBy("_p").agg(F.count("*").alias("_size"))
    before = sizes.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_size").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return inside.join(F.broadcast(before), F.col("_p") == F.col("_q")).select(name, (F.col("_before") + F.col("_n") - 1).cast("long").alias("dense"))


def dense_ids(df: DataFrame, name: str) -> DataFrame:
    return df.join(id_map(df, name), name).drop(name).withColumnRenamed("dense", name).select(*df.columns)


def remap_users(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dense user ids from train; test rows of users it lacks go."""
    ids = id_map(train, "user_id")

    def use(df: DataFrame) -> DataFrame:
        return df.join(ids, "user_id").drop("user_id").withColumnRenamed("dense", "user_id").select(*df.columns)

    return use(train), use(test)


def data_info(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.max("user_id") + 1, F.lit(0)).alias("n_users"), F.coalesce(F.max("item_id") + 1, F.lit(0)).alias("n_items"), F.count("*").alias("n_ratings"))


def pivot(df: DataFrame, items: list[int]) -> DataFrame:
    """users x items, mean on duplicates, 0 where nothing is rated; the caller names the items, so no job looks for them."""
    return df.groupBy("user_id").pivot("item_id", items).avg("rating").na.fill(0.0)


#: Ids of users or items pruned that are broadcast at most; more are met by a shuffle.
PRUNED_IDS = 1_000_000


def prune_once(df: DataFrame, min_user: int, min_item: int) -> DataFrame:
    """Users first, then items among what is left; 0 switches a side off."""
    return prune(df, min_user, min_item, 1)


def prune(df: DataFrame, min_user: int, min_item: int, rounds: int | None = None) -> DataFrame:
    """Rounds of users first, then items among what is left, until nothing goes or for ``rounds``; 0 switches a side off.

    What goes stays gone, so ratings are neither cut nor shuffled again each round: both sides are counted once, a round
    counts only the ratings that a side lost with what went on the other, and the list of ids that went is applied at the end.
    """
    from tastemill.operators.iterate import cut

    least = {side: n for side, n in (("user_id", min_user), ("item_id", min_item)) if n > 0}
    if not least or rounds == 0:
        return df
    now = cut(df)
    counts = {side: cut(now.groupBy(side).agg(F.count("*").alias("_n"))) for side in least}
    gone: dict[str, DataFrame] = {}
    sizes: dict[str, int] = {}

    def those(rows: DataFrame, side: str, went: bool) -> DataFrame:
        """Ratings whose ``side`` went or has no id, or the others."""
        ids = gone[side].withColumnRenamed(side, "_gone")
        hit = F.col(side).isNull() | F.col("_gone").isNotNull()
        return rows.join(F.broadcast(ids) if sizes[side] <= PRUNED_IDS else ids, F.col(side) == F.col("_gone"), "left").where(hit if went else ~hit).drop("_gone")

    done, before = 0, None
    while before != sizes and done != rounds:
        done, before = done + 1, dict(sizes)
        for side, n in least.items():
            left = counts[side].withColumn("_lost", F.lit(0))
            for other in gone.keys() - {side}:
                lost = those(now.select(side, other), other, True).groupBy(side).agg(F.count("*").alias("_lost"))
                left = counts[side].join(lost, side, "left").na.fill(0, ["_lost"])
            gone[side] = cut(left.where(F.col(side).isNotNull() & (F.col("_n") - F.col("_lost") < n)).select(side))
            sizes[side] = gone[side].count()
    for side in gone:
        now = those(now, side, False)
    return cut(now) if rounds is None else now  # what follows a fixpoint reads it many times


def most_active(df: DataFrame, n_users: int, n_items: int) -> DataFrame:
    users = df.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").limit(n_users).select("user_id")
    items = df.groupBy("item_id").count().orderBy(F.desc("count"), "item_id").limit(n_items).select("item_id")
    return df.join(users, "user_id", "left_semi").join(items, "item_id", "left_semi")


def sparsity(df: DataFrame) -> DataFrame:
    """1 - ratings / (users x items), by two partial aggregates rather than a distinct over all."""
    users, items = df.groupBy("user_id").agg(F.count("*").alias("n")), df.groupBy("item_id").agg(F.count("*").alias("m"))
    u = users.agg(F.count("*").alias("n_users"), F.sum("n").alias("n_ratings"))
    return u.crossJoin(items.agg(F.count("*").alias("n_items"))).select("n_users", "n_items", "n_ratings", (1 - F.col("n_ratings") / (F.col("n_users") * F.col("n_items"))).alias("sparsity"))


def user_profile(df: DataFrame, n_items: int | None = None) -> DataFrame:
    """count, mean, population std, and the share of items without a rating."""
    items = F.lit(n_items) if n_items else None
    if items is None:
        total = df.select("item_id").distinct().agg(F.count("*").alias("_items"))
        df = df.crossJoin(F.broadcast(total))
        items = F.first("_items")
    return df.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("rating").alias("mean"), F.stddev_pop("rating").alias("std"), (1 - F.count("*") / items).alias("empty"))


def item_profile(df: DataFrame) -> DataFrame:
    return df.groupBy("item_id").agg(F.count("*").alias("n"), F.avg("rating").alias("mean"), F.stddev_pop("rating").alias("std"))


TINY = 1e-12


def normalize(df: DataFrame, how: str) -> DataFrame:
    """``df`` with its column z. Global statistics are one broadcast row; per-user ones an aggregate that is joined back, so no window holds a user's rows."""
    if how == "none":
        return df.withColumn("z", F.col("rating"))
    if how in ("global_mean", "zscore"):
        stats = F.broadcast(df.agg(F.avg("rating").alias("_m"), F.stddev_pop("rating").alias("_s")))
        met = df.crossJoin(stats)
    elif how in ("user_mean", "user_mean_center", "user_zscore", "zscore_guarded"):
        met = df.join(df.groupBy("user_id").agg(F.avg("rating").alias("_m"), F.stddev_pop("rating").alias("_s")), "user_id")
    else:
        raise ValueError(f"unknown normalization: {how}")
    least = 0.0 if how == "zscore_guarded" else TINY  # the guarded form only centres where the deviation is exactly 0
    scale = F.when(F.col("_s") > least, F.col("_s")).otherwise(1.0) if how in ("zscore", "user_zscore", "zscore_guarded") else F.lit(1.0)
    return met.withColumn("z", (F.col("rating") - F.col("_m")) / scale).drop("_m", "_s")


def scale_state(df: DataFrame, how: str) -> DataFrame:
    """user_id, _shift, _scale of a normalization, to be applied to rows that it was not fitted on and taken back from predictions."""
    own = df.groupBy("user_id").agg(F.avg("rating").alias("_m"), F.stddev_pop("rating").alias("_s"))
    if how in ("global_mean", "zscore"):
        whole = F.broadcast(df.agg(F.avg("rating").alias("_m"), F.stddev_pop("rating").alias("_s")))
        own = own.select("user_id").crossJoin(whole)
    elif how not in ("user_mean", "user_mean_center", "user_zscore", "zscore_guarded"):
        raise ValueError(f"unknown normalization: {how}")
    least = 0.0 if how == "zscore_guarded" else TINY
    scale = F.when(F.col("_s") > least, F.col("_s")).otherwise(1.0) if how in ("zscore", "user_zscore", "zscore_guarded") else F.lit(1.0)
    return own.select("user_id", F.col("_m").alias("_shift"), scale.alias("_scale"))


def apply_scale(df: DataFrame, state: DataFrame) -> DataFrame:
    """Rows on the scale of ``state``; users that it lacks keep theirs."""
    z = (F.col("rating") - F.coalesce("_shift", F.lit(0.0))) / F.coalesce("_scale", F.lit(1.0))
    return df.join(state, "user_id", "left").withColumn("rating", z).drop("_shift", "_scale")


def remove_biases(df: DataFrame) -> DataFrame:
    """Rows less mean and one-shot biases of users and items, which ``add_biases`` puts back."""
    b = biases(df)
    return b.select("user_id", "item_id", (F.col("rating") - F.col("mu") - F.col("b_u") - F.col("b_i")).alias("rating"), "mu", "b_u", "b_i")


def add_biases(df: DataFrame, value: str = "rating") -> DataFrame:
    return df.withColumn(value, F.col(value) + F.col("mu") + F.col("b_u") + F.col("b_i")).drop("mu", "b_u", "b_i")


def biases(df: DataFrame) -> DataFrame:
    """One shot: mu, mean of user - mu, mean of item - mu, with every rating."""
    mu = F.broadcast(df.agg(F.avg("rating").alias("mu")))
    u, i = df.groupBy("user_id").agg(F.avg("rating").alias("_u")), df.groupBy("item_id").agg(F.avg("rating").alias("_i"))
    met = df.join(u, "user_id").join(i, "item_id").crossJoin(mu)
    return met.select("user_id", "item_id", "rating", "mu", (F.col("_u") - F.col("mu")).alias("b_u"), (F.col("_i") - F.col("mu")).alias("b_i"))


def alternating_biases(df: DataFrame, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """(user_id, b_u) and (item_id, b_i): means of what the other side leaves, users first."""
    from tastemill.operators.iterate import cut

    df = cut(df.select("user_id", "item_id", "rating"))  # read once, not in every round
    mu = df.agg(F.avg("rating")).first()[0] or 0.0
    b_i = df.select("item_id").distinct().withColumn("b_i", F.lit(0.0))
    b_u = None
    for _ in range(rounds):
        b_u = df.join(b_i, "item_id").groupBy("user_id").agg(F.avg(F.col("rating") - F.lit(mu) - F.col("b_i")).alias("b_u"))
        b_i = cut(df.join(b_u, "user_id").groupBy("item_id").agg(F.avg(F.col("rating") - F.lit(mu) - F.col("b_u")).alias("b_i")))
    return b_u, b_i


def restore(z, mean, std, bias=None):
    """From the normalized scale back: bias first, then scale and mean."""
    value = z if bias is None else z + bias
    return value * std + mean


def column_z(df: DataFrame, names: list[str]) -> DataFrame:
    """Each column minus its mean over its population std (left alone where that is 0)."""
    stats = df.agg(*[F.avg(c).alias(f"{c}_m") for c in names], *[F.stddev_pop(c).alias(f"{c}_s") for c in names])
    met = df.crossJoin(F.broadcast(stats))
    return met.select(*[c for c in df.columns if c not in names], *[ratio(F.col(c) - F.col(f"{c}_m"), F.col(f"{c}_s"), 0.0).alias(c) for c in names])


def project(df: DataFrame, name: str, n: int, d: int, seed: int = 42) -> DataFrame:
    """The array column ``name`` of n features times a normal n x d matrix of variance 1 / (n d), the same for one seed."""
    import numpy as np

    from tastemill.functions.scalars import dot

    w = np.random.RandomState(seed).normal(0, np.sqrt(1 / (n * d)), (n, d))
    return df.withColumn(name, F.array(*[dot(F.col(name), F.array(*map(F.lit, w[:, k].tolist()))) for k in range(d)]))
