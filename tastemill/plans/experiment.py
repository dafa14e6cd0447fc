"""Runs from a configuration: cross validation, clustering with neighbours, assignments, scenarios, and the command line's parts.

Folds, scenarios and clusters are columns of one plan where they can be; the driver
loops only over what is fitted in turn (folds, algorithms, hyper-parameters).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from copy import deepcopy
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.functions.scalars import r6
from tastemill.operators import evaluate as E
from tastemill.operators import factorize as M
from tastemill.operators import neighbours as N
from tastemill.operators import predict as P
from tastemill.operators import prepare as R
from tastemill.operators import ratings_clusters as RC
from tastemill.operators import splits as SP
from tastemill.plans import assignments as A
from tastemill.plans.jobs import all_or_raise, side_by_side
from tastemill.plans.reports import grid, logger, missing_tags, write_evaluation
from tastemill.sources.readers import load_config
from tastemill.sources.store import Store

DEFAULTS = {
    "run": {"seed": 42, "workers": 1},
    "data": {"dataset": "events", "folds": 5, "seed": "s3"},
    "preprocess": {"normalize": "user_mean", "min_user": 0, "min_item": 0},
    "model": {"name": "wnmf", "n_components": 6, "rounds": 5},
    "clustering": {"algorithm": "kmeans", "k": 5, "space": "latent", "rounds": 5},
    "gray": {"threshold": 3.0, "strategy": "same"},
    "recommender": {"kind": "cf", "neighbours": 30},
    "evaluation": {"at_n": [5, 10], "threshold": 3.5},
}


def settings(path: str | None = None, overrides: list[str] | None = None) -> dict:
    return load_config(path, overrides, deepcopy(DEFAULTS))


def name_of(config: dict) -> str:
    return "__".join(str(x) for x in (config["data"]["dataset"], config["preprocess"]["normalize"], config["model"]["name"], config["clustering"]["algorithm"], config["clustering"]["k"]))


def run_all(spark: SparkSession, ratings: DataFrame, config: dict, jobs: list[dict], workers: int = 1) -> DataFrame:
    """The configuration with each job's ``section.key`` values, ``workers`` at a time; (experiment, fold, metric, value)."""
    settings_ = []
    for job in jobs:
        one = deepcopy(config)
        for name, value in job.items():
            section, key = name.split(".", 1)
            one[section][key] = value
        settings_.append(one)
    works = [lambda one=one: cross_validate(spark, ratings, one).withColumn("experiment", F.lit(name_of(one))) for one in settings_]
    return stacked(all_or_raise(side_by_side(spark, works, workers)))


def stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class Registry:
    """Named parts of a pipeline; an unknown name is an error that says which there are."""

    def __init__(self, kind: str):
        self.kind, self.parts = kind, {}

    def add(self, name: str):
        def put(f):
            self.parts[name] = f
            return f

        return put

    def get(self, name: str):
        if name not in self.parts:
            raise ValueError(f"unknown {self.kind}: {name} (there are {', '.join(sorted(self.parts))})")
        return self.parts[name]


SPACES, RECOMMENDERS = Registry("space"), Registry("recommender")


@SPACES.add("raw")
def raw_space(train: DataFrame, config: dict) -> tuple[DataFrame, int]:
    return A.features(train, {})


@SPACES.add("latent")
def latent_space(train: DataFrame, config: dict) -> tuple[DataFrame, int]:
    m = config["model"]
    return A.features(train, {"factors": m["n_components"], "rounds": m["rounds"]})


@SPACES.add("pca")
def pca_space(train: DataFrame, config: dict) -> tuple[DataFrame, int]:
    return A.features(train, {"zscore": True, "pca": config["model"]["n_components"]})


def fit_labels(ratings: DataFrame, config: dict) -> DataFrame:
    """user_id, cluster_id, is_gray: vectors of the space, clusters, and gray users by their profile."""
    c = config["clustering"]
    vectors, d = SPACES.get(c["space"])(ratings, config)
    vectors = A.C.cut(vectors)  # every round reads them
    near, _ = A.Clustering(c["algorithm"], c["k"], d, seed=config["run"]["seed"], rounds=c["rounds"], space=c["space"]).fit_predict(vectors)
    gray = A.C.gray_by_profile(R.user_profile(ratings), config["gray"]["threshold"])
    return near.select(F.col("vec_id").alias("user_id"), F.col("nearest").alias("cluster_id")).join(gray.select("user_id", "is_gray"), "user_id", "left").na.fill(False, ["is_gray"])


@RECOMMENDERS.add("cf")
def cf_recommender(train: DataFrame, labels: DataFrame, config: dict) -> N.Predictor:
    return N.Routed(train, labels, config["gray"]["strategy"], k=config["recommender"]["neighbours"])


@RECOMMENDERS.add("mf")
def mf_recommender(train: DataFrame, labels: DataFrame, config: dict) -> N.Predictor:
    m = config["model"]
    if m["name"] == "wnmf":
        return M.fit_factors(train, rank=m["n_components"], rounds=m["rounds"]).predict
    return lambda targets: M.get_model(m["name"])(train, targets.withColumn("rating", F.lit(0.0)) if "rating" not in targets.columns else targets, n_components=m["n_components"], rounds=m["rounds"])


@RECOMMENDERS.add("cluster_average")
def average_recommender(train: DataFrame, labels: DataFrame, config: dict) -> N.Predictor:
    return lambda targets: P.cluster_average(train, targets, labels)


def fit_pipeline(ratings: DataFrame, config: dict) -> tuple[DataFrame, N.Predictor, Callable[[DataFrame, Column], Column], DataFrame | None]:
    """(train on the model's scale, predictor, restore, state): pruned, normalized, clustered, the way back to the ratings' scale, and what made it (none: the ratings' own)."""
    how = config["preprocess"]["normalize"]
    pruned = R.prune(ratings, config["preprocess"]["min_user"], config["preprocess"]["min_item"])
    labels = A.C.cut(fit_labels(pruned, config))
    positive = config["recommender"]["kind"] == "mf" and config["model"]["name"] == "wnmf"
    if how == "none" or positive:
        return pruned, RECOMMENDERS.get(config["recommender"]["kind"])(pruned, labels, config), lambda df, x: x, None
    state = A.C.cut(R.scale_state(pruned, how))
    train = R.apply_scale(pruned, state)

    predictor = RECOMMENDERS.get(config["recommender"]["kind"])(train, labels, config)

    def restore(df: DataFrame, x: Column) -> Column:
        return x * F.coalesce(F.col("_scale"), F.lit(1.0)) + F.coalesce(F.col("_shift"), F.lit(0.0))

    def with_state(targets: DataFrame) -> DataFrame:
        return predictor(targets).join(state, "user_id", "left")

    if hasattr(predictor, "lists"):  # lists are on the model's scale
        with_state.lists = predictor.lists
    return train, with_state, restore, state


def cross_validate(spark: SparkSession, ratings: DataFrame, config: dict, workers: int = 1) -> DataFrame:
    """fold, metric, value of each fold, ``workers`` at a time; each is cut as it ends."""
    folds = A.C.cut(SP.kfold(ratings, config["data"]["folds"], config["data"]["seed"]))
    items, ev = folds.select("item_id").distinct(), config["evaluation"]

    def one(fold: int) -> DataFrame:
        train, test = folds.where(F.col("fold") != fold).drop("fold"), folds.where(F.col("fold") == fold).drop("fold")
        fitted, predictor, restore, state = fit_pipeline(train, config)
        scaled = test if state is None else R.apply_scale(test, state)
        return A.C.cut(N.evaluate_fold(fitted, scaled, predictor, items, restore, tuple(ev["at_n"]), ev["threshold"]).withColumn("fold", F.lit(fold)))

    return stacked(all_or_raise(side_by_side(spark, [lambda f=f: one(f) for f in range(config["data"]["folds"])], workers)))


def run_experiment(spark: SparkSession, ratings: DataFrame, config: dict, workers: int = 1) -> DataFrame:
    """metric, mean, std over folds."""
    return N.aggregate_folds(cross_validate(spark, ratings, config, workers))


def smoke(spark: SparkSession, ratings: DataFrame) -> DataFrame:
    """The defaults with two folds: does every part fit the next."""
    return run_experiment(spark, ratings, settings(overrides=["data.folds=2", "clustering.k=3", "model.rounds=2"]))


def clustering_cf(ratings: DataFrame, k: int, rounds: int = 10, n: int = 10, neighbours: int = 30, assignment: DataFrame | None = None, algorithm: str = "mk_means", how: dict | None = None, seed: int = 42) -> DataFrame:
    """One algorithm end to end: mk-means++ over the train ratings, a named search over the features ``how`` (or an assignment that there is), neighbours inside clusters, errors and lists."""
    cut = SP.user_holdout(ratings)
    train, test = A.C.cut(cut.where("NOT is_test").drop("is_test")), A.C.cut(cut.where("is_test").drop("is_test"))
    if assignment is None and algorithm == "mk_means":
        _, labels = RC.mk_means(train, k, rounds)
        assignment = labels.withColumn("is_gray", F.lit(False))
    elif assignment is None:
        vectors, d = A.features(train, how or {"factors": 6, "rounds": rounds})
        near = A.run_one(A.C.cut(vectors), A.choose([algorithm], (*A.ALGORITHMS, *A.SCREENED))[0], k, d, 10, rounds, seed)["near"]
        assignment = near.select(F.col("vec_id").alias("user_id"), F.col("nearest").alias("cluster_id")).withColumn("is_gray", F.lit(False))
    return N.evaluate_cf(train, test, N.Knn(train, assignment, k=neighbours), ratings.select("item_id").distinct(), n)


def compare(spark: SparkSession, ratings: DataFrame, algorithms: list[str], k: int, rounds: int = 5, n: int = 10, workers: int = 1) -> DataFrame:
    """algorithm and what ``clustering_cf`` gives for it; one that fails has a row with its error alone."""
    found = side_by_side(spark, [lambda a=a: A.C.cut(clustering_cf(ratings, k, rounds, n, algorithm=a)) for a in algorithms], workers)
    parts = [spark.createDataFrame([(a, f"{type(x).__name__}: {x}"[:300])], "algorithm string, error string") if isinstance(x, Exception) else x.select(F.lit(a).alias("algorithm"), "*") for a, x in zip(algorithms, found, strict=True)]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def produce_assignments(spark: SparkSession, store: Store, ratings: DataFrame, dataset: str, names: list[str], k: int, how: dict, size: int = 8, epochs: int = 5, seed: int = 42, workers: int = 1, limit: float | None = None, **run: object) -> DataFrame:
    """Every named algorithm over the same features, ``workers`` at a time, stored; a failure (or one beyond ``limit`` seconds) is logged and the others go on.

    ``run``: further settings of ``run_one`` (objective, gray, threshold, members ...). Returns the rows of the run.
    """
    log, number = logger(), store.start_run(f"assignments {' '.join(names)}", dataset, k, "assignments", A.suffix(how))
    vectors, d = A.features(ratings, how)
    vectors, labels = A.C.cut(vectors), A.choose(names)

    def one(label: str) -> float:
        result = A.run_one(vectors, label, k, d, size, epochs, seed, ratings=ratings, **run)
        A.store_run(spark, store, result, dataset, k, A.suffix(how), number)
        log.info("%s: wcss %.4f in %.1f s", label, result["wcss"], result["seconds"])
        return result["wcss"]

    failed = False
    for label, x in zip(labels, side_by_side(spark, [lambda x=x: one(x) for x in labels], workers, limit), strict=True):
        if isinstance(x, Exception):
            failed = True
            log.warning("%s failed: %s", label, x)
    store.finish_run(number, "failed" if failed else "done")
    return store.read("assignments").where(F.col("run_id") == number)


def scenarios(train: DataFrame, test: DataFrame, labels: DataFrame, rank: int = 6, rounds: int = 6, epochs: int = 5, members: DataFrame | None = None) -> DataFrame:
    """scenario, segment, n, mae, rmse: the global model, a model for each cluster, fixed item factors for each cluster, cluster means and neighbours, on the same split."""
    items = A.C.cut(M.wnmf(train, rank=rank, rounds=rounds)[1])
    a, b = train.join(labels, "user_id"), test.join(labels, "user_id")
    pale = lambda df: df.where("NOT is_gray")
    rule = M.Rule.biased_model(rank, epochs)
    made = {
        "global": M.get_model("svd")(train, test, n_components=rank, rounds=rounds),
        "cluster_full": M.cluster_models(pale(a), pale(b).drop("is_gray"), rule).unionByName(M.gray_models(a, b, rule)),
        "cluster_sharedV": M.shared_items(pale(a), pale(b).drop("is_gray"), items, rank).unionByName(M.gray_shared(a, b.drop("is_gray") if "is_gray" not in b.columns else b, items, rank)),
        "cluster_avg": P.cluster_average(train, test, labels),
        "cluster_knn": N.knn(train, test, labels),
    }
    if members is not None:
        made["cluster_avg_soft"] = P.soft_cluster_average(train, test, labels, members)
    out = None
    for name, done in made.items():
        rows = E.errors_by_segment(done, labels).select(F.lit(name).alias("scenario"), "segment", "n", "mae", "rmse")
        out = rows if out is None else out.unionByName(rows)
    return out


def run_scenarios(spark: SparkSession, store: Store, ratings: DataFrame, dataset: str, algo: str, k: int, preprocessing: list[str], tags: list[dict] | None = None, folds: int = 0, done: DataFrame | None = None, workers: int = 1) -> DataFrame:
    """Scenarios of a stored assignment for every setting (``tags``: rank, rounds, epochs), over folds or one holdout, ``workers`` at a time; settings with a result are skipped. Memberships, if stored, are used. Rows are stored and returned."""
    from tastemill.sources.store import prioritized

    order = spark.createDataFrame(list(enumerate(preprocessing)), "ordinal int, preprocessing string")
    own = store.read("assignments").where((F.col("dataset") == dataset) & (F.col("algo") == algo) & (F.col("k") == k))
    row = prioritized(own, order).select("id", "preprocessing").first()
    if row is None:
        raise LookupError(f"no assignment of {dataset}, {algo}, {k}, {preprocessing}")
    labels, members = store.labels(row["id"]).select("user_id", "cluster_id", "is_gray"), store.memberships(row["id"])
    members = None if members.isEmpty() else members
    jobs = [{"tag": f"k{k}_ld{t['rank']}_eg{t['rounds']}_ec{t['epochs']}", **t} for t in (tags or [{"rank": 4, "rounds": 2, "epochs": 2}])]
    wanted = {r["tag"] for r in missing_tags(spark.createDataFrame([(k, j["tag"], False) for j in jobs], "k long, tag string, svdpp boolean"), done).collect()}
    run = store.start_run(f"scenarios {algo}", dataset, k, "scenarios", row["preprocessing"])
    parts = SP.kfold(ratings, folds) if folds else SP.user_holdout(ratings).withColumn("fold", F.when(F.col("is_test"), 0).otherwise(1)).drop("is_test")
    parts = A.C.cut(parts)

    def one(job: dict, fold: int) -> DataFrame:
        train, test = parts.where(F.col("fold") != fold).drop("fold"), parts.where(F.col("fold") == fold).drop("fold")
        return A.C.cut(scenarios(train, test, labels, job["rank"], job["rounds"], job["epochs"], members).withColumns({"fold": F.lit(fold), "tag": F.lit(job["tag"])}))

    works = [lambda j=j, f=f: one(j, f) for j in jobs if j["tag"] in wanted for f in range(folds or 1)]
    if not works:
        store.finish_run(run, "skipped")
        return spark.createDataFrame([], "scenario string, segment string, n long, mae double, rmse double, fold int, tag string")
    out = stacked(all_or_raise(side_by_side(spark, works, workers)))
    for r in out.where("segment = 'total'").collect():  # scenarios x folds x settings
        store.save_result(dataset, algo, k, row["preprocessing"], r["scenario"], row["id"], run, cv_fold=r["fold"], mae=r["mae"], rmse=r["rmse"], tag=r["tag"])
    store.finish_run(run)
    return out


def cv_means(rows: DataFrame) -> DataFrame:
    """Scenario rows over folds: means, and the folds' values as text."""
    return E.cross_validation_table(rows.where("segment = 'total'").withColumnRenamed("fold", "cv_fold"), ["scenario", "tag"])


def screening(spark: SparkSession, store: Store, df: DataFrame, names: list[str], k: int, d: int, runs: int = 2, size: int = 6, epochs: int = 10, top: int = 5, limit: float | None = None, stop_after: float | None = None, workers: int = 1) -> dict[str, DataFrame]:
    """Repeated runs, the best algorithms by the composite score, how these converge, and the hybrid that follows; the behaviour is stored."""
    every, history = A.screen(df, names, k, d, runs, size, epochs, limit=limit, stop_after=stop_after, workers=workers)
    every, history = A.C.cut(every), A.C.cut(history)
    best = A.C.cut(A.ranked(every, top))
    table = A.C.cut(A.behaviour(every, history).join(best.select("algorithm"), "algorithm", "left_semi"))
    if not table.isEmpty():
        store.save_behaviour(table.select(F.lit(0).cast("long").alias("run_num"), "algorithm", "final_wcss", F.col("convergence_speed").cast("double").alias("convergence_speed"), "exploration_ratio", "category"))
    notes = best.select("algorithm", "score", A.family(F.col("algorithm")).alias("family"))
    return {"runs": every, "success": every.where("success"), "failed": every.where("NOT success"), "best": best, "behaviour": table, "notes": notes}


def k_sweep(df: DataFrame, d: int, ks: list[int], rounds: int = 10) -> DataFrame:
    """k, wcss, silhouette, davies_bouldin, seconds of Lloyd's rounds for each k; ``elbow`` and the best ones follow from it."""
    rows = []
    for k in ks:
        began = time.time()
        _, near = A.C.lloyd(df, A.C.seed_by_distance(df, k, f"k{k}"), d, rounds)
        labelled = df.join(near.select("vec_id", F.col("nearest").alias("cluster_id")), "vec_id").select("vec_id", "v", "cluster_id")
        own = A.C.centroids(labelled, d)
        rows.append((k, near.agg(r6(F.sum("d2"))).first()[0], A.C.silhouette(labelled).first()["silhouette"], A.C.davies_bouldin(labelled, own).first()["davies_bouldin"], time.time() - began))
    return df.sparkSession.createDataFrame(rows, "k long, wcss double, silhouette double, davies_bouldin double, seconds double")


def recommendations(ratings: DataFrame, assignment: DataFrame, n: int = 10, max_users: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, lists, evaluation) of a stored assignment on a holdout; ``max_users`` keeps ids below it."""
    if max_users is not None:
        ratings = ratings.where(F.col("user_id") < max_users)
    cut = SP.user_holdout(ratings)
    train, test = A.C.cut(cut.where("NOT is_test").drop("is_test")), A.C.cut(cut.where("is_test").drop("is_test"))
    done, lists = N.artifacts(train, test, assignment, ratings.select("item_id").distinct(), n)
    done, lists = A.C.cut(done), A.C.cut(lists)
    return done, lists, N.evaluate_artifacts(done, lists, test, n)


def command(spark: SparkSession, args: list[str]) -> str:
    """The command line: ``experiment``, ``assign``, ``scenarios``, ``evaluate``, ``sweep``, ``screen``, ``compare``, ``runs`` and ``assignments``; returns what it prints.

    An option that is not given is taken from ``TASTEMILL_<OPTION>``, if that is set.
    """
    import argparse
    import os

    from tastemill.plans.reports import text_table
    from tastemill.sources import fixtures
    from tastemill.sources.store import last_runs

    p = argparse.ArgumentParser(prog="tastemill")
    p.add_argument("what", choices=["experiment", "assign", "scenarios", "evaluate", "sweep", "screen", "compare", "runs", "assignments"])
    p.add_argument("--data", help="folder of the tables")
    p.add_argument("--store", default="store")
    p.add_argument("--out")
    p.add_argument("--config")
    p.add_argument("--set", nargs="*", default=[], help="section.key=value")
    p.add_argument("--algorithms", nargs="*", default=["B0_KMEANS"])
    p.add_argument("--k", type=int, default=5)
    p.add_argument("--dataset", default="events")
    p.add_argument("--epochs", type=int, default=3)
    p.add_argument("--factors", type=int, default=4)
    p.add_argument("--top", type=int, default=10)
    p.add_argument("--ks", nargs="*", type=int, default=[2, 5, 10])
    p.add_argument("--repeats", type=int, default=2)
    p.add_argument("--size", type=int, default=8)
    p.add_argument("--workers", type=int, default=1)
    p.add_argument("--limit", type=float, help="seconds of a run")
    p.add_argument("--seed", type=int, default=42)
    for option in p._actions:
        if option.option_strings and (given := os.environ.get(f"TASTEMILL_{option.dest.upper()}")) is not None:
            kind = option.type or str
            p.set_defaults(**{option.dest: [kind(x) for x in given.split()] if option.nargs == "*" else kind(given)})
    a = p.parse_args(args)
    store, how = Store(spark, a.store), {"factors": a.factors, "rounds": 4}
    if a.what == "runs":
        return text_table(last_runs(store.runs()))
    if a.what == "assignments":
        return store.listing()
    ratings = fixtures.ratings(spark, a.data)
    if a.what == "experiment":
        out = run_experiment(spark, ratings, settings(a.config, [f"run.seed={a.seed}", *a.set]), a.workers)
    elif a.what == "assign":
        out = produce_assignments(spark, store, ratings, a.dataset, a.algorithms, a.k, how, a.size, a.epochs, a.seed, a.workers, a.limit).select("id", "algo", "k", "wcss", "gray_count", "n_users")
    elif a.what == "scenarios":
        out = run_scenarios(spark, store, ratings, a.dataset, a.algorithms[0], a.k, [A.suffix(how)])
    elif a.what == "screen":
        vectors, d = A.features(ratings, how)
        out = screening(spark, store, A.C.cut(vectors), a.algorithms, a.k, d, a.repeats, a.size, a.epochs, a.top, a.limit, workers=a.workers)["notes"]
    elif a.what == "compare":
        out = compare(spark, ratings, a.algorithms, a.k, a.epochs, a.top, a.workers)
    elif a.what == "sweep":
        vectors, d = A.features(ratings, how)
        out = k_sweep(A.C.cut(vectors), d, a.ks)
    else:
        row = store.read("assignments").orderBy(F.desc("id")).first()
        out = recommendations(ratings, store.labels(row["id"]).select("user_id", "cluster_id", "is_gray"), a.top)[2]
        if a.out:
            write_evaluation(out, a.out)
    return text_table(out)


__all__ = ["command", "cross_validate", "cv_means", "fit_pipeline", "grid", "run_experiment", "run_scenarios", "scenarios", "screening", "settings"]
