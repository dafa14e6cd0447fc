"""Producing assignments: the table of algorithms, features, one run from search to stored labels, and repeated screening.

Everything here runs over vectors (vec_id, v); a user's vector is made of ratings by
``features``. The driver loops over algorithms and generations; each generation is a
job whose result is as large as the population.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.functions.scalars import order_hash, r6
from tastemill.operators import clusters as C
from tastemill.operators import search as O
from tastemill.operators import sparse as SV
from tastemill.operators import swarms  # noqa: F401  (it adds its searches to ours)
from tastemill.operators.evaluate import composite_rank, convergence, run_summary
from tastemill.operators.iterate import cut
from tastemill.plans.jobs import all_or_raise, limited, side_by_side

#: Labels of assignment runs and the search each stands for (fixed values).
ALGORITHMS = {
    "B0_KMEANS": "KMEANS",
    "B1_HHO": "HHO",
    "B2_HGS": "HGS",
    "H1_HHO+HGS": "HHO+HGS",
    "H4_MFO+HHO": "MFO+HHO",
    "B3_MFO": "MFO",
    "H9_QSA+CDO": "QSA+CDO",
    "H12_MFO+CDO": "MFO+CDO",
    "H13_HHO+GAop": "HHO+GAop",
    "H5_GAHHO": "GAHHO",
    "DE_HHO": "DE-HHO",
    "H5_EliteGA+HHO": "ELITEMULTIGA+HHO",
    "LIT_GOA": "GOA",
    "LIT_GWO": "GWO",
    "LIT_SSA": "SSA-DEV",
}
#: Searches of the screening phase.
SCREENED = ("CIRCLESA", "BES", "TSO", "HHO", "HGS", "WOA", "BA", "MULTIGA", "DE", "GWO", "GOA", "PSO", "ABC", "AGTO", "AVOA", "MFO", "TWO", "SMA", "BEESA")
ALIASES = {"K-MEANS": "B0_KMEANS", "KMEANS": "B0_KMEANS", "GOA": "LIT_GOA", "GWO": "LIT_GWO", "SSA": "LIT_SSA", "HHO": "B1_HHO", "MFO": "B3_MFO", "DE-HHO": "DE_HHO", "HGS": "B2_HGS", "GAHHO": "H5_GAHHO"}


def choose(names: list[str], known=tuple(ALGORITHMS), aliases: dict[str, str] | None = None, prefixes: tuple[str, ...] = (), banned: tuple[str, ...] = ()) -> list[str]:
    """Names as labels: aliases resolved, banned ones and (if prefixes are given) others than these left out, each once, in the order given.

    A name that is in no table is an error that lists all of them.
    """
    table = {k.upper(): v for k, v in (ALIASES if aliases is None else aliases).items()}
    own = {k.upper(): k for k in known}
    found = [own.get(table.get(n.strip().upper(), n.strip()).upper()) for n in names]
    if lost := [n for n, f in zip(names, found, strict=True) if f is None]:
        raise KeyError(f"unknown algorithms: {', '.join(lost)}")
    return [f for f in dict.fromkeys(found) if f not in banned and (not prefixes or f.startswith(prefixes))]


def choose_rows(rows: DataFrame, aliases: DataFrame, banned: list[str]) -> DataFrame:
    """The same over a table (name): ``aliases`` (name, label); the first row of each label stays, none of the banned."""
    met = rows.join(F.broadcast(aliases.withColumnRenamed("name", "_n")), F.upper("name") == F.upper("_n"), "left").select(F.coalesce("label", "name").alias("name"), "ordinal")
    return met.where(~F.col("name").isin(banned)).groupBy("name").agg(F.min("ordinal").alias("ordinal"))


def check_known(names: DataFrame, catalogue: DataFrame) -> DataFrame:
    """names ⋈ catalogue on name; a name without an entry is an error."""
    lost = names.join(catalogue, "name", "left_anti").limit(20).collect()
    if lost:
        raise KeyError(f"not in the catalogue: {', '.join(r['name'] for r in lost)}")
    return names.join(catalogue, "name")


def features(ratings: DataFrame, how: dict) -> tuple[DataFrame, int]:
    """Vectors of users and their length, in this order: prune, user z-score, unit rows, then PCA or non-negative factors.

    ``how``: min_user, min_item, zscore, unit, pca (components or share of variance), factors; pca and factors
    together are an error. With factors or pca (vec_id, v); without either a place for each item, as (vec_id, ids, vals).
    """
    from tastemill.functions.scalars import scale_rows
    from tastemill.operators import factorize, prepare

    if how.get("pca") and how.get("factors"):
        raise ValueError("pca and factors exclude each other")
    df = prepare.prune(ratings, how.get("min_user", 0), how.get("min_item", 0))
    if how.get("factors"):
        users, _ = factorize.wnmf(df, rank=how["factors"], rounds=how.get("rounds", 20))
        out = users.select(F.col("user_id").alias("vec_id"), F.col("p").alias("v"))
        return (out.select("vec_id", scale_rows(F.col("v")).alias("v")) if how.get("unit") else out), how["factors"]
    if how.get("zscore"):
        df = prepare.normalize(df, "user_zscore").select("user_id", "item_id", F.col("z").alias("rating"))
    items = prepare.id_map(df, "item_id")
    d = items.count()
    out = SV.from_cells(df.join(items, "item_id").select(F.col("user_id").alias("vec_id"), F.col("dense").alias("dim"), F.col("rating").alias("value")))
    out = SV.unit(out) if how.get("unit") else out
    if how.get("pca"):
        share = how["pca"] if 0 < how["pca"] < 1 else None
        out, cumulative = factorize.pca_sparse(out, d, k=None if share else int(how["pca"]), variance=share, whiten=how.get("whiten", False))
        d = len(cumulative)
    return out, d


def suffix(how: dict) -> str:
    """The name of a preprocessing."""
    parts = [f"prune_u{how.get('min_user', 0)}_i{how.get('min_item', 0)}"]
    parts += ["zscore"] if how.get("zscore") else []
    if pca := how.get("pca"):
        parts.append(f"pca{int(pca * 100)}pct" if pca < 1 else f"pca{int(pca)}")
    if how.get("factors"):
        parts.append(f"wnmf{how['factors']}")
    return "_".join(parts)


def bounds(df: DataFrame, k: int, d: int, kind: str = "data") -> tuple[np.ndarray, np.ndarray]:
    """Box of the centres: ``raw`` [1, 5]; ``centred`` [-4, 4]; ``search`` [0, max(5, 1.5 max)]; ``data`` smallest to largest value, a little wider, or around 0 if constant."""
    if kind == "raw":
        low, high = 1.0, 5.0
    elif kind == "centred":
        low, high = -4.0, 4.0
    else:
        if SV.is_sparse(df):  # places that a vector lacks are 0
            least, most = F.when(F.size("ids") < d, F.least(F.array_min("vals"), F.lit(0.0))).otherwise(F.array_min("vals")), F.when(F.size("ids") < d, F.greatest(F.array_max("vals"), F.lit(0.0))).otherwise(F.array_max("vals"))
        else:
            least, most = F.array_min("v"), F.array_max("v")
        low, high = df.agg(F.min(least), F.max(most)).first()
        if kind == "search":
            low, high = 0.0, max(5.0, 1.5 * high + 1e-6)
        elif abs(high - low) + 2e-6 <= 3e-6:
            wide = max(abs(low), abs(high), 1.0)
            low, high = -wide, wide
        else:
            low, high = low - 1e-6, high + 1e-6
    return np.full(k * d, low), np.full(k * d, high)


@dataclass
class Clustering:
    """k-means, fuzzy c-means or a population search over (vec_id, v), by name."""

    algorithm: str
    k: int
    d: int
    seed: int = 42
    rounds: int = 20
    space: str = "latent"
    size: int = 10
    epochs: int = 10

    def fit_predict(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(vec_id, nearest, d2) and centres (cluster_id, c), or (cluster_id, dim, value) of vectors with a place for each item."""
        session, name = df.sparkSession, self.algorithm.lower().replace("-", "_")
        n = df.limit(self.k).count()
        if n == 0:
            raise ValueError("no vectors")
        k = min(self.k, n)
        if SV.is_sparse(df) and name in ("fcm", "kmeans", "k_means"):
            if name == "fcm":
                centres, _ = SV.fuzzy_c_means(df, max(2, k), self.d, self.rounds)
                return SV.nearest(df, centres, max(2, k), self.d), centres
            centres, near = SV.lloyd(df, SV.seed_by_distance(df, k, self.d, f"km{self.seed}"), k, self.d, self.rounds)
            return near, centres
        if name == "fcm":
            centres, near = C.fuzzy_c_means(df, max(2, k), self.d, self.rounds)
            return near, centres
        if name.startswith("meta_"):
            problem = Problem(df, k, self.d)
            r = problem.solve(self.algorithm[5:], self.size, self.epochs, self.seed, *bounds(df, k, self.d, "raw" if self.space == "raw" else "data"))
            return problem.assign(r.best), problem.centres(r.best)
        if name not in ("kmeans", "k_means"):
            raise ValueError(f"unknown clustering: {self.algorithm}")
        found, near = C.lloyd(df, C.seed_by_distance(df, k, f"km{self.seed}"), self.d, self.rounds)
        return near, session.createDataFrame(list(enumerate(found)), "cluster_id long, c array<double>")


@dataclass
class Problem:
    """Clustering as a problem of k d numbers: scores of candidates in one job, and the labels of one of them."""

    df: DataFrame
    k: int
    d: int
    penalty: float = 1000.0
    objective: str = "wcss"

    @property
    def dim(self) -> int:
        return self.k * self.d

    def __post_init__(self):
        if self.objective not in ("wcss", "composite"):
            raise ValueError(f"unknown objective: {self.objective}")
        self.score = O.clustering_objective(self.df, self.k, self.d, self.penalty) if self.objective == "wcss" else O.Composite(self.df, self.k, self.d)

    def fitness(self, population: np.ndarray) -> np.ndarray:
        return self.score(np.atleast_2d(population))

    def centres(self, x: np.ndarray) -> DataFrame:
        return self.df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(x.reshape(self.k, self.d).tolist())], "cluster_id long, c array<double>")

    def assign(self, x: np.ndarray) -> DataFrame:
        return C.nearest(self.df, self.centres(x)) if not SV.is_sparse(self.df) else SV.nearest(self.df, SV.long_form(self.centres(x)), self.k, self.d)

    def seedings(self, seeds: list[str]) -> np.ndarray:
        """k centres drawn by squared distance for each seed, flat; all seeds in the same k jobs."""
        if SV.is_sparse(self.df):
            return np.array([self.flat(SV.seed_by_distance(self.df, self.k, self.d, seed)) for seed in seeds])
        return np.array(C.seeds_by_distance(self.df, self.k, seeds)).reshape(len(seeds), -1)

    def flat(self, centres: DataFrame) -> np.ndarray:
        out = np.zeros((self.k, self.d))
        for r in centres.collect():  # k d numbers, like every candidate
            out[r["cluster_id"], r["dim"]] = r["value"]
        return out.ravel()

    def starts(self, n: int, seed: int = 42) -> np.ndarray:
        """n seedings by squared distance, each with a seed of its own."""
        return self.seedings([f"s{seed}.{i}" for i in range(n)])

    def k_means(self, seed: str, rounds: int) -> np.ndarray:
        if SV.is_sparse(self.df):
            return self.flat(SV.lloyd(self.df, SV.seed_by_distance(self.df, self.k, self.d, seed), self.k, self.d, rounds)[0])
        return np.array(C.lloyd(self.df, C.seed_by_distance(self.df, self.k, seed), self.d, rounds)[0]).ravel()

    def solve(self, name: str, size: int, epochs: int, seed: int, low: np.ndarray, high: np.ndarray, start: np.ndarray | None = None) -> O.Result:
        return O.get_optimizer(name)(self.fitness, low, high, size, epochs, seed, start)


def gray_choice(near: DataFrame, how: str, threshold: float, features: DataFrame | None, neighbours: int, contamination: float | None) -> tuple[DataFrame, float]:
    """(vec_id, dist, is_gray) and the threshold: ``distance`` beyond it, ``percentile`` above the 80th, or by the outlier factor (``lof``) of ``features`` (vec_id, v)."""
    if how == "lof":
        return C.gray_by_factor(features, neighbours, contamination)
    dist = near.withColumn("dist", r6(F.sqrt("d2")))
    if how == "percentile":
        threshold = dist.agg(F.percentile("dist", F.lit(0.8))).first()[0]
        return dist.select("vec_id", "dist", (F.col("dist") > threshold).alias("is_gray")), threshold
    if how != "distance":
        raise ValueError(f"unknown choice of gray users: {how}")
    return dist.select("vec_id", "dist", (F.sqrt("d2") > threshold).alias("is_gray")), threshold


def run_one(
    df: DataFrame, label: str, k: int, d: int, size: int = 10, epochs: int = 10, seed: int = 42, gray: str = "distance", threshold: float = 0.8, restarts: int = 1,
    objective: str = "wcss", ratings: DataFrame | None = None, neighbours: int = 20, contamination: float | None = None, members: bool = False,
) -> dict:
    """One algorithm from search to labels: label, seconds, wcss (always of the clustering), near (vec_id, nearest, d2), labels (vec_id, cluster_id, is_gray, dist), threshold, centres and history.

    ``objective``: what searches minimise (DE-HHO always the sum of squares). ``gray``: distance, percentile, or lof, which needs the users'
    ``ratings`` (mean, share rated, spread, deviation from the cluster). ``members``: also memberships (vec_id, cluster_id, w) of the centres.
    """
    began, name = time.time(), ALGORITHMS.get(label, label)
    problem = Problem(df, k, d, objective="wcss" if name == "DE-HHO" else objective)
    if name == "KMEANS":
        x, history = problem.k_means(f"km{seed}", max(epochs, 1)), []
    else:
        low, high = bounds(df, k, d)
        start = O.multi_start(problem.fitness, lambda seeds: problem.seedings([f"m{s}" for s in seeds]), restarts, size, seed) if restarts else None
        r = problem.solve(name, size, epochs, seed, low, high, start)
        x, history = r.best, r.history
    centres, near = problem.centres(x), cut(problem.assign(x))
    features_ = None
    if gray == "lof":
        if ratings is None:
            raise ValueError("gray users by outlier factor need ratings")
        own = near.select(F.col("vec_id").alias("user_id"), F.col("nearest").alias("cluster_id"))
        features_ = cut(C.outlier_features(ratings, own).withColumnRenamed("user_id", "vec_id"))
    dist, limit = gray_choice(near, gray, threshold, features_, neighbours, contamination)
    labels = near.join(dist, "vec_id").select("vec_id", F.when(F.col("is_gray"), F.lit(k)).otherwise(F.col("nearest")).cast("long").alias("cluster_id"), "is_gray", "dist")
    out = {"algorithm": label, "seed": seed, "wcss": near.agg(r6(F.sum("d2"))).first()[0], "near": near, "labels": labels, "centres": centres, "history": history, "threshold": limit}
    if members:
        w = SV.memberships(df, SV.long_form(centres), k, d) if SV.is_sparse(df) else C.memberships(df, centres).select("vec_id", F.col("cid").alias("cluster_id"), "w")
        out["members"] = w
    return out | {"seconds": time.time() - began}


ROW = "algorithm string, run_num int, success boolean, wcss double, silhouette double, davies_bouldin double, gray_count double, gray_ratio double, seconds double, error string"


def screening_row(df: DataFrame, label: str, run: int, k: int, d: int, size: int, epochs: int, seed: int, limit: float | None = None) -> tuple[tuple, list[float]]:
    """One run as a row; a failure, or one that was stopped after ``limit`` seconds, is a row with its error."""
    try:
        return limited(df.sparkSession, lambda: screened(df, label, run, k, d, size, epochs, seed), limit)
    except Exception as error:  # a failed run is data here
        return failed_row(label, run, error)


def failed_row(label: str, run: int, error: Exception) -> tuple[tuple, list[float]]:
    return (label, run, False, None, None, None, None, None, None, f"{type(error).__name__}: {error}"[:300]), []


def screened(df: DataFrame, label: str, run: int, k: int, d: int, size: int, epochs: int, seed: int) -> tuple[tuple, list[float]]:
    r = run_one(df, label, k, d, size, epochs, seed)
    rows = df.join(C.nearest(df, r["centres"]).select("vec_id", F.col("nearest").alias("cluster_id")), "vec_id").select("vec_id", "v", "cluster_id")
    scores = C.quality(rows, d)
    n, ratio = r["labels"].agg(F.sum(F.col("is_gray").cast("double")), F.avg(F.col("is_gray").cast("double"))).first()
    return (label, run, True, float(r["wcss"]), scores["silhouette"], scores["davies_bouldin"], n, ratio, r["seconds"], None), r["history"]


WEIGHTS = {"wcss": 0.35, "davies_bouldin": 0.15, "seconds": 0.30, "silhouette": 0.15, "gray_ratio": 0.05}


def screen(df: DataFrame, labels: list[str], k: int, d: int, runs: int = 3, size: int = 8, epochs: int = 8, seed: int = 10_000, limit: float | None = None, stop_after: float | None = None, workers: int = 1, save: Callable[[DataFrame], None] | None = None, every: int = 10) -> tuple[DataFrame, DataFrame]:
    """(all runs, history): every label in every run, ``workers`` at a time; one is stopped after ``limit`` seconds, and none starts once ``stop_after`` seconds are over.

    ``save`` gets the rows of each ``every`` runs once they are done, so that what is lost with the driver is bounded.
    """
    session, rows, past = df.sparkSession, [], []
    jobs = list(product(range(runs), labels))
    works = [lambda run=run, label=label: screening_row(df, label, run, k, d, size, epochs, seed + run, limit) for run, label in jobs]
    until = None if stop_after is None else time.time() + stop_after
    for lo in range(0, len(works), max(1, every)):
        done = all_or_raise(side_by_side(session, works[lo : lo + max(1, every)], workers, start_until=until))
        rows += [row for row, _ in done]
        past += [(row[0], row[1], i, float(f)) for row, history in done for i, f in enumerate(history)]
        if save is not None and done:
            save(session.createDataFrame([row for row, _ in done], ROW))
    return session.createDataFrame(rows, ROW), session.createDataFrame(past, "algorithm string, run_num int, epoch long, fitness double")


def ranked(runs: DataFrame, n: int = 5) -> DataFrame:
    """Means over runs of algorithms that never failed, with the composite score; the n best."""
    means = run_summary(runs, ["algorithm"], list(WEIGHTS)).where("success")
    return composite_rank(means, WEIGHTS).orderBy(F.desc("score"), "algorithm").limit(n)


def behaviour(runs: DataFrame, history: DataFrame) -> DataFrame:
    """How each algorithm's first run converged, with its final score and mean time."""
    first = convergence(history.where("run_num = 0").select("algorithm", "epoch", "fitness"))
    ends = runs.where("success").groupBy("algorithm").agg(r6(F.avg("wcss")).alias("final_wcss"), F.avg("seconds").alias("time"))
    return first.join(ends, "algorithm")


def select_hybrid(table: DataFrame) -> tuple[str, str]:
    """(global, local) of a behaviour table of some dozen rows."""
    return O.choose_hybrid([r.asDict() for r in table.orderBy("algorithm").collect()])


def family(name):
    """Column: what kind of search a label stands for."""
    return (
        F.when(name.contains("||"), "parallel hybrid").when(F.upper(name).contains("GAOP"), "memetic").when(name.contains("+"), "sequential hybrid").when(F.upper(name).contains("KMEANS"), "clustering").when(F.upper(name).contains("DE_HHO") | F.upper(name).contains("DE-HHO"), "embedded hybrid").otherwise("single")
    )


def five_minutes() -> dict:
    """A quick look: few epochs and points, and a stop by the clock."""
    return {"epochs": 8, "size": 10, "k": 20, "runs": 10, "stop_after": 300.0}


def sample_of(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(order_hash("vec_id", seed="pick"), "vec_id").limit(n)


def store_run(spark: SparkSession, store, result: dict, dataset: str, k: int, preprocessing: str, run_id: int) -> int:
    """Saves a run's labels with their statistics; the id of the assignment."""
    labels = result["labels"].select(F.col("vec_id").alias("user_id"), "cluster_id", "is_gray", F.col("dist").alias("score"))
    return store.save_assignment(labels, members=result.get("members"), dataset=dataset, algo=result["algorithm"], k=k, preprocessing=preprocessing, run_id=run_id, seed=result["seed"], wcss=float(result["wcss"]))
