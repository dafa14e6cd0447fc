"""Factor models: weighted non-negative factors, biased and probabilistic SGD, per-cluster and shared-item models.

Global models are driver loops of joins and partial aggregates over the observed
ratings; each round is cut from the lineage before it. Biased and probabilistic SGD,
global, per cluster or of the gray users, walk blocks of ratings (``stratified``), so
no group has to fit a task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.functions.scalars import clip, dot, order_hash
from tastemill.operators import stratified
from tastemill.operators.iterate import cut
from tastemill.operators.stratified import Rule

TINY = 1e-10


def start_factors(ids: DataFrame, name: str, rank: int, seed: str) -> DataFrame:
    """0.1 + a hash in [0, 0.03): positive, and the same on every run."""
    u = [F.conv(F.substring(order_hash(name, seed=f"{seed}{k}"), 1, 8), 16, 10).cast("double") / float(1 << 32) for k in range(rank)]
    return ids.select(name, F.array(*[0.1 + 0.03 * x for x in u]).alias("w"))


def spectral_start(cells: DataFrame, rank: int, rounds: int = 4, seed: str = "nnd") -> tuple[DataFrame, DataFrame]:
    """Absolute left vectors times singular values, and absolute right vectors times singular values, of the users x items table with gaps at the mean.

    The table is never built: it is the mean everywhere plus (rating - mean) where rated, so a product with
    a thin matrix is a join and a sum. ``rounds`` of subspace iteration over items x rank numbers.
    """
    mu = cells.agg(F.avg("rating")).first()[0] or 0.0
    users, items = cells.select("user_id").distinct(), cells.select("item_id").distinct()
    thin = start_factors(items, "item_id", rank, f"{seed}0").select("item_id", F.transform("w", lambda x: x - 0.115).alias("q"))
    diff = cells.select("user_id", "item_id", (F.col("rating") - F.lit(mu)).alias("d"))

    def times(far: DataFrame, near_ids: DataFrame, key: str, other: str, col: str, out: str) -> DataFrame:
        total = F.broadcast(far.agg(F.array(*[F.sum(F.col(col)[k]) for k in range(rank)]).alias("_t")))
        own = diff.join(far, other).groupBy(key).agg(F.array(*[F.sum(F.col("d") * F.col(col)[k]) for k in range(rank)]).alias("_o"))
        met = near_ids.join(own, key, "left").crossJoin(total)
        return met.select(key, F.transform(F.sequence(F.lit(0), F.lit(rank - 1)), lambda k: F.lit(mu) * F.col("_t")[k] + F.coalesce(F.col("_o")[k], F.lit(0.0))).alias(out))

    def gram(df: DataFrame, col: str) -> np.ndarray:
        sums = df.agg(*[F.sum(F.col(col)[i] * F.col(col)[j]) for i in range(rank) for j in range(rank)]).first()
        return np.array(sums, float).reshape(rank, rank)

    def turned(df: DataFrame, key: str, col: str, m: np.ndarray, out: str) -> DataFrame:
        return df.select(key, F.array(*[dot(F.col(col), F.array(*map(F.lit, m[:, k].tolist()))) for k in range(rank)]).alias(out))

    def orthogonal(df: DataFrame, key: str, col: str) -> DataFrame:
        values, vectors = np.linalg.eigh(gram(df, col))
        return turned(df, key, col, vectors / np.sqrt(np.maximum(values, 1e-12)), col)

    thin = orthogonal(cut(thin), "item_id", "q")
    for _ in range(rounds):
        wide = cut(times(thin, users, "user_id", "item_id", "q", "p"))
        thin = cut(orthogonal(times(wide, items, "item_id", "user_id", "p", "q"), "item_id", "q"))
    wide = cut(times(thin, users, "user_id", "item_id", "q", "p"))
    values, vectors = np.linalg.eigh(gram(wide, "p"))
    order = np.argsort(-values)
    size = np.sqrt(np.maximum(values[order], 0.0))
    left = turned(wide, "user_id", "p", vectors[:, order], "p").select("user_id", F.transform("p", lambda x: F.greatest(F.abs(x), F.lit(TINY))).alias("p"))
    right = turned(thin, "item_id", "q", vectors[:, order] * size, "q").select("item_id", F.transform("q", lambda x: F.greatest(F.abs(x), F.lit(TINY))).alias("q"))
    return left, right


def wnmf(
    ratings: DataFrame, rank: int = 20, rounds: int = 50, alpha: float = 0.01, beta: float = 0.01, tolerance: float = 1e-4, seed: str = "wnmf", every: int = 10, init: str = "hash"
) -> tuple[DataFrame, DataFrame]:
    """(user_id, p), (item_id, q) by multiplicative updates over observed cells; items are updated before users.

    Starts from positive hashes or, with ``init="nndsvda"``, from the singular vectors of the table with gaps at
    the mean. Looks at the loss (squared error and both ridges) after the first round and every ``every`` more, and stops
    when it moved by less than ``tolerance``.
    """
    cells = cut(ratings.select("user_id", "item_id", "rating"))
    if init == "nndsvda":
        users, items = spectral_start(cells, rank)
    elif init == "hash":
        users = start_factors(cells.select("user_id").distinct(), "user_id", rank, f"{seed}u").withColumnRenamed("w", "p")
        items = start_factors(cells.select("item_id").distinct(), "item_id", rank, f"{seed}i").withColumnRenamed("w", "q")
    else:
        raise ValueError(f"unknown start: {init}")
    last = None
    for n in range(rounds):
        items = cut(update(cells, users, items, "item_id", "q", "p", beta, rank))
        users = cut(update(cells, users, items, "user_id", "p", "q", alpha, rank))
        if n % every == 0:
            e = F.col("rating") - dot(F.col("p"), F.col("q"))
            loss = cells.join(users, "user_id").join(items, "item_id").agg(F.sum(e * e)).first()[0] or 0.0
            loss += alpha * (users.agg(F.sum(dot(F.col("p"), F.col("p")))).first()[0] or 0.0) + beta * (items.agg(F.sum(dot(F.col("q"), F.col("q")))).first()[0] or 0.0)
            if last is not None and abs(last - loss) < tolerance:
                break
            last = loss
    return users, items


def update(cells: DataFrame, users: DataFrame, items: DataFrame, key: str, own: str, far: str, ridge: float, rank: int) -> DataFrame:
    met = cells.join(users, "user_id").join(items, "item_id").withColumn("_fit", dot(F.col("p"), F.col("q")))
    sums = [F.sum(F.col(far)[k] * F.col("rating")).alias(f"_a{k}") for k in range(rank)] + [F.sum(F.col(far)[k] * F.col("_fit")).alias(f"_b{k}") for k in range(rank)]
    mine = users if key == "user_id" else items
    out = met.groupBy(key).agg(*sums).join(mine, key)
    new = [F.greatest(F.lit(TINY), F.col(own)[k] * F.col(f"_a{k}") / (F.col(f"_b{k}") + F.lit(ridge) * F.col(own)[k] + F.lit(TINY))) for k in range(rank)]
    return out.select(key, F.array(*new).alias(own))


def als(ratings: DataFrame, targets: DataFrame, rank: int = 20, rounds: int = 10, reg: float = 0.1, non_negative: bool = True, seed: int = 42, offset: Column | None = None) -> DataFrame:
    """Alternating least squares on rating - mean (on the ratings themselves if factors are non-negative); what it has not seen gets the mean. Clipped.

    Ids of any size: both sides are mapped to dense ones first. With ``offset``, a column that both frames can
    compute, factors explain what it leaves, and unseen cells get it alone.
    """
    from pyspark.ml.recommendation import ALS

    from tastemill.operators.prepare import id_map

    mu = ratings.agg(F.avg("rating")).first()[0]
    base = offset if offset is not None else F.lit(0.0 if non_negative else mu)
    alone = offset if offset is not None else F.lit(mu)
    u, i = cut(id_map(ratings, "user_id").withColumnRenamed("dense", "_u")), cut(id_map(ratings, "item_id").withColumnRenamed("dense", "_i"))

    def coded(df: DataFrame, how: str) -> DataFrame:
        return df.join(u, "user_id", how).join(i, "item_id", how)

    train = coded(ratings, "inner").select(F.col("_u").cast("int"), F.col("_i").cast("int"), (F.col("rating") - base).cast("float").alias("r"))
    model = ALS(rank=rank, maxIter=rounds, regParam=reg, nonnegative=non_negative, userCol="_u", itemCol="_i", ratingCol="r", seed=seed, coldStartStrategy="nan").fit(train)
    asked = coded(targets, "left").withColumns({"_base": base, "_alone": alone, "_u": F.coalesce("_u", F.lit(-1)).cast("int"), "_i": F.coalesce("_i", F.lit(-1)).cast("int")})
    out = model.transform(asked)
    return out.select("user_id", "item_id", "rating", clip(F.coalesce(F.nanvl(F.col("prediction").cast("double"), F.lit(None)) + F.col("_base"), F.col("_alone"))).alias("pred"))


def biased(ratings: DataFrame, targets: DataFrame, rank: int = 20, rounds: int = 10, reg: float = 0.1, seed: int = 42, bias_rounds: int = 10) -> DataFrame:
    """The global biased model by least squares: mean, alternating biases of users and items, and factors of what they leave. Clipped.

    The same model as biased SGD (``MODELS["svd"]``), fitted in another way: few rounds of joins instead of epochs of steps.
    """
    from tastemill.operators.prepare import alternating_biases

    cells = cut(ratings.select("user_id", "item_id", "rating"))
    mu = cells.agg(F.avg("rating")).first()[0] or 0.0
    b_u, b_i = alternating_biases(cells, bias_rounds)
    b_u, b_i = cut(b_u), cut(b_i)

    def shifted(df: DataFrame) -> DataFrame:
        return df.join(b_u, "user_id", "left").join(b_i, "item_id", "left").withColumn("_off", F.lit(mu) + F.coalesce("b_u", F.lit(0.0)) + F.coalesce("b_i", F.lit(0.0)))

    return als(shifted(cells), shifted(targets), rank, rounds, reg, False, seed, F.col("_off"))


def probabilistic(ratings: DataFrame, targets: DataFrame, rank: int = 20, rounds: int = 10, sigma_sq: float = 0.5, sigma_u_sq: float = 5.0, seed: int = 42) -> DataFrame:
    """The maximum of the probabilistic model on rating - mean: least squares with ridge sigma^2 / sigma_U^2. Clipped."""
    return als(ratings, targets, rank, rounds, sigma_sq / sigma_u_sq, False, seed)


@dataclass
class Factors:
    """A fitted model: factors of users (user_id, p) and items (item_id, q). What it has not seen has no prediction."""

    users: DataFrame
    items: DataFrame

    def predict(self, targets: DataFrame, clipped: bool = False) -> DataFrame:
        x = dot(F.col("p"), F.col("q"))
        return targets.join(self.users, "user_id").join(self.items, "item_id").select(*targets.columns, (clip(x) if clipped else x).alias("pred"))

    def recommend(self, train: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:
        """Lists of unseen items by the factors alone."""
        from tastemill.operators.neighbours import recommend

        return recommend(train, users, self.items.select("item_id"), self.predict, n)


def fit_factors(ratings: DataFrame, **how) -> Factors:
    return Factors(*wnmf(ratings, **how))


#: Global models by name: (train, targets, parameters) -> targets with pred.
MODELS: dict[str, Callable[..., DataFrame]] = {
    "wnmf": lambda train, targets, n_components=20, alpha=0.01, beta=0.01, rounds=20, init="hash": fit_factors(train, rank=n_components, alpha=alpha, beta=beta, rounds=rounds, init=init).predict(targets),
    "svd": lambda train, targets, n_components=20, lr=0.005, reg=0.02, rounds=20: stratified.fit(train, Rule.biased_model(n_components, rounds, lr, reg)).predict(targets),
    "pmf": lambda train, targets, n_components=20, lr=0.005, sigma_sq=1.0, sigma_U_sq=1.0, sigma_V_sq=1.0, rounds=20: stratified.fit(train, Rule.probabilistic_model(n_components, rounds, lr, sigma_sq, sigma_U_sq, sigma_V_sq)).predict(targets),
    "svd_als": lambda train, targets, n_components=20, reg=0.1, rounds=10: biased(train, targets, n_components, rounds, reg),
    "pmf_als": lambda train, targets, n_components=20, sigma_sq=0.5, sigma_U_sq=5.0, rounds=10: probabilistic(train, targets, n_components, rounds, sigma_sq, sigma_U_sq),
}


def get_model(name: str) -> Callable[..., DataFrame]:
    try:
        return MODELS[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown model: {name}") from None


def tuning_objective(ratings: DataFrame, model: str, bounds: dict[str, tuple[float, float]], fixed: dict | None = None, seed: str = "s5") -> Callable[[np.ndarray], np.ndarray]:
    """Validation error (mean absolute) of points of the unit box; without ratings 10. One fit a point."""
    from tastemill.functions.scalars import decode_unit
    from tastemill.operators.splits import tuning_slice

    cells = cut(tuning_slice(ratings.select("user_id", "item_id", "rating"), seed))
    train, valid = cells.where("NOT is_valid").drop("is_valid"), cells.where("is_valid").drop("is_valid")
    empty, fit = valid.isEmpty(), get_model(model)

    def score(population: np.ndarray) -> np.ndarray:
        out = []
        for x in np.atleast_2d(population):
            if empty:
                out.append(10.0)
                continue
            done = valid.join(fit(train, valid, **{**(fixed or {}), **decode_unit(x.tolist(), bounds)}).select("user_id", "item_id", "pred"), ["user_id", "item_id"], "left")
            out.append(done.agg(F.avg(F.abs(F.coalesce("pred", F.lit(0.0)) - F.col("rating")))).first()[0])
        return np.array(out)

    return score


def tune(ratings: DataFrame, model: str, bounds: dict[str, tuple[float, float]], optimizer: str = "PSO", size: int = 4, epochs: int = 3, seed: int = 42, fixed: dict | None = None) -> tuple[dict[str, float], float]:
    """(parameters, error) of the best point that a population search finds."""
    from tastemill.functions.scalars import decode_unit
    from tastemill.operators.search import get_optimizer

    d = len(bounds)
    r = get_optimizer(optimizer)(tuning_objective(ratings, model, bounds, fixed), np.zeros(d), np.ones(d), size, epochs, seed)
    return decode_unit(r.best.tolist(), bounds), r.fitness


def gray_models(train: DataFrame, targets: DataFrame, rule: Rule, least: int = 5) -> DataFrame:
    """All gray users (is_gray) as one more group with a model of its own; fewer than ``least`` rows give no predictions."""
    dark = lambda df: df.where("is_gray").withColumn("cluster_id", F.lit(-1).cast("long"))
    return cluster_models(dark(train), dark(targets), rule, least)


def gray_shared(train: DataFrame, targets: DataFrame, items: DataFrame, rank: int, ridge: float = 0.1) -> DataFrame:
    """The same on fixed item factors."""
    dark = lambda df: df.where("is_gray").withColumn("cluster_id", F.lit(-1).cast("long"))
    return shared_items(dark(train).drop("is_gray"), dark(targets), items, rank, ridge)


def cluster_profiles(users: DataFrame, labels: DataFrame, rank: int) -> DataFrame:
    """cluster_id, p_k: the mean factor of a cluster's users, for users without factors."""
    return users.join(labels.select("user_id", "cluster_id"), "user_id").groupBy("cluster_id").agg(F.array(*[F.avg(F.col("p")[k]) for k in range(rank)]).alias("p_k"))


def blended(targets: DataFrame, profiles: DataFrame, items: DataFrame, members: DataFrame, labels: DataFrame, base: Column | None = None) -> DataFrame:
    """Users without factors: predictions of the clusters' profiles weighted by membership (user_id, cluster_id, w); without a positive weight, that of the user's own cluster. Clipped."""
    shift = base if base is not None else F.lit(0.0)
    met = targets.join(items, "item_id")
    each = met.join(members, "user_id").join(profiles, "cluster_id").select(*targets.columns, "cluster_id", (dot(F.col("p_k"), F.col("q")) + shift).alias("pred"))
    soft = soft_blend(each, members).select("user_id", "item_id", F.col("pred").alias("_soft"))
    hard = met.join(labels.select("user_id", "cluster_id"), "user_id").join(profiles, "cluster_id").select(*targets.columns, (dot(F.col("p_k"), F.col("q")) + shift).alias("_hard"))
    return hard.join(soft, ["user_id", "item_id"], "left").select(*targets.columns, clip(F.coalesce("_soft", "_hard")).alias("pred"))


def cluster_models(train: DataFrame, targets: DataFrame, rule: Rule, least: int = 5) -> DataFrame:
    """Each cluster with a model of its own, all fitted at once (``stratified``); clusters of fewer than ``least`` train rows give no predictions. Both have cluster_id."""
    return stratified.fit(train, rule, "cluster_id", least).predict(targets, "cluster_id").select("user_id", "item_id", "rating", "pred")


def shared_items(train: DataFrame, targets: DataFrame, items: DataFrame, rank: int, ridge: float = 0.1, gray_weight: float = 1.0) -> DataFrame:
    """Item factors (item_id, q) stay fixed; each user is a ridge regression on them, per cluster mean mu_k and item bias.

    The normal equations are sums over a user's ratings (rank^2 partial
    aggregates); only the small solve runs in Python, batch by batch. Users
    without train rows get the mean factor of their cluster.
    """
    mean = train.groupBy("cluster_id").agg(F.avg("rating").alias("mu"))
    bias = train.join(F.broadcast(mean), "cluster_id").groupBy("item_id").agg(F.avg(F.col("rating") - F.col("mu")).alias("b_i"))
    w = F.when(F.col("is_gray"), F.lit(gray_weight)).otherwise(1.0) if "is_gray" in train.columns else F.lit(1.0)
    met = train.join(F.broadcast(mean), "cluster_id").join(bias, "item_id").join(items, "item_id").withColumn("e", F.col("rating") - F.col("mu") - F.col("b_i")).withColumn("w", w)
    pairs = [(a, b) for a in range(rank) for b in range(a, rank)]
    sums = [F.sum(F.col("w") * F.col("q")[a] * F.col("q")[b]) for a, b in pairs] + [F.sum(F.col("w") * F.col("q")[k] * F.col("e")) for k in range(rank)]
    system = met.groupBy("cluster_id", "user_id").agg(F.array(*sums).alias("s"), F.count("*").alias("n"))

    def solve(batches):
        for pdf in batches:
            out = []
            for s, n in zip(pdf.s, pdf.n, strict=True):
                m = np.zeros((rank, rank))
                for (a, b), x in zip(pairs, s, strict=False):
                    m[a, b] = m[b, a] = x
                out.append(np.linalg.solve(m + ridge * n * np.eye(rank), np.asarray(s[len(pairs) :])).tolist())
            yield pd.DataFrame({"cluster_id": pdf.cluster_id, "user_id": pdf.user_id, "p": out})

    users = cut(system.mapInPandas(solve, "cluster_id long, user_id long, p array<double>"))
    centre = users.groupBy("cluster_id").agg(F.array(*[F.avg(F.col("p")[k]) for k in range(rank)]).alias("p_k"))
    done = targets.join(users.drop("cluster_id"), "user_id", "left").join(F.broadcast(centre), "cluster_id").join(F.broadcast(mean), "cluster_id").join(bias, "item_id", "left").join(items, "item_id", "left")
    pred = F.col("mu") + F.coalesce("b_i", F.lit(0.0)) + F.coalesce(dot(F.coalesce("p", "p_k"), F.col("q")), F.lit(0.0))
    return done.select("user_id", "item_id", "rating", clip(pred).alias("pred"))


def soft_blend(predictions: DataFrame, members: DataFrame) -> DataFrame:
    """Predictions of several clusters (cluster_id) weighted by membership, divided by the weights that took part."""
    met = predictions.join(members.where("w > 0"), ["user_id", "cluster_id"]).where(~F.isnan("pred"))
    return met.groupBy("user_id", "item_id", "rating").agg((F.sum(F.col("w") * F.col("pred")) / F.sum("w")).alias("pred"))


def pca(df: DataFrame, k: int | None = None, variance: float | None = None, whiten: bool = False, d: int = 64) -> tuple[DataFrame, list[float]]:
    """vec_id and the first components of centred v, and the cumulative share of variance.

    The covariance is d^2 partial aggregates over one pass (MLlib's row matrix);
    ``variance`` keeps the fewest components that reach that share.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    mean = df.agg(F.array(*[F.avg(F.col("v")[i]) for i in range(d)]).alias("m"))
    ready = df.crossJoin(F.broadcast(mean)).select("vec_id", array_to_vector(F.zip_with("v", "m", lambda a, b: a - b)).alias("x"))
    model = PCA(k=k or d, inputCol="x", outputCol="y").fit(ready)
    share = np.cumsum(model.explainedVariance.toArray())
    keep = k or d
    if variance is not None:
        keep = min(keep, int(np.searchsorted(share, variance - 1e-12)) + 1)
    out = model.transform(ready).select("vec_id", F.slice(vector_to_array("y"), 1, keep).alias("v"))
    if whiten:
        std = out.agg(F.array(*[F.stddev_samp(F.col("v")[i]) for i in range(keep)]).alias("s"))
        out = out.crossJoin(F.broadcast(std)).select("vec_id", F.zip_with("v", "s", lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(a)).alias("v"))
    return out, share[:keep].tolist()


def pca_sparse(df: DataFrame, d: int, k: int | None = None, variance: float | None = None, whiten: bool = False) -> tuple[DataFrame, list[float]]:
    """The same of vectors with a place for each item (vec_id, ids, vals); d x d numbers on the driver, as for ``pca``, but no dense rows in the plan.

    Products of places come from pairs of a vector's own cells, so missing places cost nothing; the mean is taken off afterwards.
    """
    from tastemill.operators import sparse
    from tastemill.operators.search import blocks

    n = df.count()

    def gram(batches):
        total = np.zeros((d, d))
        for pdf in batches:
            for x in blocks(pdf, d):
                total += x.T @ x
        rows, cols = np.nonzero(total)
        step = 1_000_000
        for lo in range(0, len(rows), step):
            r, c = rows[lo : lo + step], cols[lo : lo + step]
            yield pd.DataFrame({"i": r, "j": c, "s": total[r, c]})

    found = df.select("ids", "vals").mapInPandas(gram, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    mean = np.zeros(d)
    for r in sparse.cells_of(df).groupBy("dim").agg(F.sum("value").alias("s")).collect():  # d rows
        mean[r["dim"]] = r["s"] / n
    square = np.zeros((d, d))
    square[found.i, found.j] = found.s
    values, vectors = np.linalg.eigh((square - n * np.outer(mean, mean)) / max(n - 1, 1))
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    share = np.cumsum(values / max(values.sum(), TINY))
    keep = min(k or d, d)
    if variance is not None:
        keep = min(keep, int(np.searchsorted(share, variance - 1e-12)) + 1)
    scale = np.where(values[:keep] > TINY, np.sqrt(np.maximum(values[:keep], TINY)), 1.0) if whiten else np.ones(keep)
    sent, shift = df.sparkSession.sparkContext.broadcast(vectors[:, :keep] / scale), mean @ (vectors[:, :keep] / scale)

    def turn(batches):
        for pdf in batches:
            if len(pdf):
                out = [row for x in blocks(pdf, d) for row in (x @ sent.value - shift).tolist()]
                yield pd.DataFrame({"vec_id": pdf.vec_id, "v": out})

    kind = df.schema["vec_id"].dataType.simpleString()
    return df.select("vec_id", "ids", "vals").mapInPandas(turn, f"vec_id {kind}, v array<double>"), share[:keep].tolist()
