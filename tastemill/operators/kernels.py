"""Similarities and distances of users, all from one pass of co-rating sums.

How many pairs the items make is counted first. Where a pair of users shares an item or more on
average, blocks of users meet (``blocks``) and only their vectors are shuffled. Elsewhere the self-join on
item is the cost: an item with m ratings makes m^2 / 2 rows before the partial aggregate, and their number
decides the tasks. ``within`` (user_id, cluster_id) restricts both to users of one cluster. In the join the raters of an item that more than ``BLOCK`` users rated are
dealt out in blocks that meet pair by pair, so no item is one task's work. Predictors
that know their targets build similarities from these (``neighbours``), and
``top_pairs`` keeps k for each user instead of the table of all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.functions.scalars import ratio
from tastemill.operators import blocks as B
from tastemill.operators.iterate import cut

#: Raters of an item (in a cluster) that meet in one task.
BLOCK = 4_096
#: Heavy keys that are broadcast, and ratings that are, if there are no more.
MANY, SMALL_ROWS = 100_000, 1_000_000
#: Pairs that a task should make, and the most tasks.
PAIRS, MOST_TASKS = 2_000_000, 20_000


def heavy_keys(rows: DataFrame, keys: list[str], block: int) -> DataFrame | None:
    """keys, _parts of the keys with more than ``block`` rows; None if there are none. There are fewer than rows / ``block``."""
    return heavy_of(rows.groupBy(*keys).agg(F.count("*").alias("_m")), keys, block)


def heavy_of(counts: DataFrame, keys: list[str], block: int) -> DataFrame | None:
    found = cut(counts.where(F.col("_m") > block).select(*keys, F.ceil(F.col("_m") / block).cast("int").alias("_parts")))
    return None if found.isEmpty() else found


def small_enough(found: DataFrame) -> DataFrame:
    """Broadcast if its rows are few: their number is looked at first."""
    return F.broadcast(found) if found.count() <= MANY else found


def in_blocks(many: DataFrame, few: DataFrame, keys: list[str], spread: str, block: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """(many, few, keys) ready for an equi-join on ``keys``: rows of ``many`` under a heavy key are dealt out in parts by ``spread``, and rows of ``few`` go to each part."""
    heavy = heavy_keys(many, keys, block)
    if heavy is None:
        return many, few, keys
    heavy = small_enough(heavy)
    parts = F.coalesce("_parts", F.lit(1))
    many = many.join(heavy, keys, "left").withColumn("_i", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_parts")
    few = few.join(heavy, keys, "left").withColumn("_i", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return many, few, [*keys, "_i"]


def finite(df: DataFrame, *values: str) -> Column:
    """Aggregate: ids are whole numbers and all values finite, as blocks need it."""
    if any(df.schema[c].dataType.typeName() not in ("byte", "short", "integer", "long") for c in ("user_id", "item_id")):
        return F.lit(False)
    return F.coalesce(F.bool_and(*[F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")) & (F.abs(F.col(v).cast("double")) < float("inf")) for v in values]), F.lit(True))


def pair_sums(df: DataFrame, within: DataFrame | None = None, value: str = "rating", own: bool = False) -> DataFrame:
    """u < v with n, sx, sy, sxy, sxx, syy over the items that both rated; ``own``: and qx, qy, each one's sum of squares over all its items."""
    keys = ["item_id"]
    if within is not None:
        df, keys = df.join(within.select("user_id", "cluster_id"), "user_id"), ["item_id", "cluster_id"]
    group = F.lit(0) if within is None else F.col("cluster_id")
    counts = cut(df.groupBy(*keys).agg(F.count("*").alias("_m"), finite(df, value).alias("_ok")))
    rows, pairs, ok = counts.agg(F.sum("_m"), F.sum(F.col("_m") * (F.col("_m") - 1) / 2), F.bool_and("_ok")).first()
    sizes = cut(df.groupBy(group.alias("_g")).agg(F.count_distinct("user_id").alias("_users")))
    groups, users, met = sizes.agg(F.count("*"), F.sum("_users"), F.sum(F.col("_users") * (F.col("_users") - 1) / 2)).first()
    if ok and (pairs or 0) >= (met or 0):
        found = B.block_sums(df.select(group.alias("_g"), "user_id", "item_id", F.col(value).alias("x")), sizes, groups, int(users or 0))
        return found if own else found.drop("qx", "qy")
    found = joined_sums(df, keys, counts, rows, pairs, value)
    if not own:
        return found
    squares = df.groupBy("user_id").agg(F.sum(F.col(value) * F.col(value)).alias("q"))
    return found.join(squares.toDF("u", "qx"), "u").join(squares.toDF("v", "qy"), "v")


def joined_sums(df: DataFrame, keys: list[str], counts: DataFrame, rows: int | None, pairs: float | None, value: str) -> DataFrame:
    left, right = df.select(*keys, F.col("user_id").alias("u"), F.col(value).alias("x")), df.select(*keys, F.col("user_id").alias("v"), F.col(value).alias("y"))
    # tasks by the pairs they make, not by the few bytes that they read
    n = int(min(MOST_TASKS, max(1, (pairs or 0) // PAIRS + 1)))
    if (rows or 0) <= SMALL_ROWS:
        # all pairs of a user are made in one task, so they are summed there and no pair is shuffled
        left, right = left.repartition(n, "u"), F.broadcast(right)
    elif (heavy := heavy_of(counts, keys, BLOCK)) is None:
        left, right = left.repartition(n, *keys), right.repartition(n, *keys)
    else:  # only rows of heavy items go through blocks; all others have block (0, 0)
        heavy, parts = small_enough(heavy), F.coalesce("_parts", F.lit(1))
        far = F.explode(F.sequence(F.lit(0), parts - 1))
        left = left.join(heavy, keys, "left").select(*keys, F.pmod(F.xxhash64("u"), parts).cast("int").alias("_i"), far.alias("_j"), "u", "x")
        right = right.join(heavy, keys, "left").select(*keys, far.alias("_i"), F.pmod(F.xxhash64("v"), parts).cast("int").alias("_j"), "v", "y")
        keys = [*keys, "_i", "_j"]
        left, right = left.repartition(n, *keys), right.repartition(n, *keys)
    x, y = F.col("x"), F.col("y")
    return (
        left.join(right, keys).where("u < v").groupBy("u", "v")
        .agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"))
    )


def pearson_corated(sums: DataFrame, degenerate: float = 0.0, least: int = 2, clip: bool = True) -> DataFrame:
    """Means over the common items. Fewer than ``least`` of them, or no variance: ``degenerate``."""
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    spread = (n * F.col("sxx") - sx * sx) * (n * F.col("syy") - sy * sy)
    r = ratio(n * F.col("sxy") - sx * sy, F.sqrt(F.greatest(spread, F.lit(0.0))), degenerate)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)) if clip else r
    return sums.select("u", "v", "n", F.when((n >= least) & (spread > 0), r).otherwise(degenerate).alias("sim"))


def pearson_distance(sums: DataFrame) -> DataFrame:
    return pearson_corated(sums, degenerate=-1.0, clip=False).select("u", "v", "n", (1 - F.col("sim")).alias("dist"))


def centred(df: DataFrame) -> DataFrame:
    means = df.groupBy("user_id").agg(F.avg("rating").alias("mean"))
    return df.join(means, "user_id").select("user_id", "item_id", "rating", "mean", (F.col("rating") - F.col("mean")).alias("x"))


def pearson_global_mean(df: DataFrame, within: DataFrame | None = None, min_common: int = 3) -> DataFrame:
    """Centred on the user's mean over all ratings, norms over the common items."""
    s = pair_sums(centred(df), within, "x")
    norm = F.sqrt(F.col("sxx")) * F.sqrt(F.col("syy"))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio(F.col("sxy"), norm, 0.0, 1e-8)))
    return s.select("u", "v", "n", F.when(F.col("n") >= min_common, r).otherwise(0.0).alias("sim"))


def cosine_corated(sums: DataFrame, min_common: int = 3) -> DataFrame:
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio(F.col("sxy"), F.sqrt(F.col("sxx")) * F.sqrt(F.col("syy")), 0.0, 1e-8)))
    return sums.select("u", "v", "n", F.when(F.col("n") >= min_common, c).otherwise(0.0).alias("sim"))


def pearson_own_norm(df: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """Product over the intersection, norms over each side's own ratings."""
    s = pair_sums(centred(df), within, "x", own=True)
    return s.select("u", "v", "n", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio(F.col("sxy"), F.sqrt("qx") * F.sqrt("qy"), 0.0))).alias("sim"))


def euclid_corated(sums: DataFrame) -> DataFrame:
    return sums.select("u", "v", "n", F.sqrt(F.greatest(F.lit(0.0), F.col("sxx") - 2 * F.col("sxy") + F.col("syy"))).alias("dist"))


def both_ways(pairs: DataFrame, value: str = "sim") -> DataFrame:
    return pairs.select("u", "v", value).unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), value))


def centroid_pearson(df: DataFrame, centroids: DataFrame) -> DataFrame:
    """User against centroid (cluster_id, item_id, value): over the user's rated items, both centred there. 1 - r."""
    met = df.join(centroids, "item_id").groupBy("user_id", "cluster_id")
    x, y = F.col("rating"), F.col("value")
    s = met.agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"))
    left, right = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    r = ratio(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.sqrt(F.greatest(left, F.lit(0.0))) * F.sqrt(F.greatest(right, F.lit(0.0))), 0.0, 1e-10)
    return s.select("user_id", "cluster_id", (1 - r).alias("dist"))


def centroid_euclid(df: DataFrame, centroids: DataFrame) -> DataFrame:
    d = (F.col("rating") - F.col("value")) * (F.col("rating") - F.col("value"))
    return df.join(centroids, "item_id").groupBy("user_id", "cluster_id").agg(F.sqrt(F.sum(d)).alias("dist"))


def union_correlation(df: DataFrame, centroids: DataFrame, users: DataFrame) -> DataFrame:
    """Correlation where either side is not zero, zeros kept; degenerate distance 1.

    The sums of the union need no outer join: each side's own sums, and the
    product over the intersection, with n = rated + positive - both.
    """
    own = df.groupBy("user_id").agg(F.count("*").alias("nu"), F.sum("rating").alias("su"), F.sum(F.col("rating") * F.col("rating")).alias("qu"))
    far = centroids.where("value <> 0").groupBy("cluster_id").agg(F.count("*").alias("nc"), F.sum("value").alias("sc"), F.sum(F.col("value") * F.col("value")).alias("qc"))
    both = df.join(centroids.where("value <> 0"), "item_id").groupBy("user_id", "cluster_id").agg(F.count("*").alias("nb"), F.sum(F.col("rating") * F.col("value")).alias("p"))
    met = own.join(users.select("user_id"), "user_id").crossJoin(F.broadcast(far)).join(both, ["user_id", "cluster_id"], "left").na.fill(0)
    n = F.col("nu") + F.col("nc") - F.col("nb")
    spread = (n * F.col("qu") - F.col("su") * F.col("su")) * (n * F.col("qc") - F.col("sc") * F.col("sc"))
    r = ratio(n * F.col("p") - F.col("su") * F.col("sc"), F.sqrt(F.greatest(spread, F.lit(0.0))), 0.0)
    return met.select("user_id", "cluster_id", F.when((n >= 2) & (spread > 0), 1 - r).otherwise(1.0).alias("dist"))
