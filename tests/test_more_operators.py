"""Operators beyond the twins: fixtures by hand, errors, files, the store, the steppers and the runners."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.functions import scalars
from tastemill.operators import clusters, factorize, neighbours, predict, prepare, ratings_clusters, search
from tastemill.plans import assignments, experiment, reports
from tastemill.sources import readers, sinks, store

R = "user_id long, item_id long, rating double"


def ratings(spark, users=12, items=9, seed=0):
    draw = np.random.RandomState(seed)
    return spark.createDataFrame([(u, i, float(draw.randint(1, 6))) for u in range(users) for i in range(items) if draw.rand() < 0.7], R)


def labels(spark, users=12, k=3):
    return spark.createDataFrame([(u, u % k, u % 5 == 0) for u in range(users)], "user_id long, cluster_id long, is_gray boolean")


def table(df):
    return {(r.user_id, r.item_id): r.rating for r in df.collect()}


# ---- neighbours


def brute_knn(train, targets, cluster, gray, low, k, white):
    by = {}
    for (u, i), r in train.items():
        by.setdefault(u, {})[i] = r
    mean = {u: sum(x.values()) / len(x) for u, x in by.items()}

    def sim(a, b):
        common = sorted(set(by.get(a, {})) & set(by.get(b, {})))
        if len(common) < 2:
            return low
        x, y = np.array([by[a][i] for i in common]), np.array([by[b][i] for i in common])
        x, y = x - x.mean(), y - y.mean()
        d = np.linalg.norm(x) * np.linalg.norm(y)
        return float(x @ y / d) if d > 1e-12 else low

    out = {}
    for u, i in targets:
        near = [(sim(u, v), v) for v in by if v != u and cluster[v] == cluster[u] and i in by[v] and not (white and gray[v])]
        near = sorted(near, key=lambda s: (-abs(round(s[0], 6)), s[1]))[:k]
        down = sum(abs(s) for s, _ in near)
        base = mean.get(u, 0.0)
        out[u, i] = base + sum(s * (by[v][i] - mean[v]) for s, v in near) / down if down > 1e-10 else base
    return out


@pytest.mark.parametrize(("white", "kernel", "low"), [(False, "pearson", -1.0), (True, "pearson_zero", 0.0)])
def test_knn_against_brute_force(spark, white, kernel, low):
    every = ratings(spark)
    train, test = every.where("(user_id + item_id) % 4 <> 0"), every.where("(user_id + item_id) % 4 = 0").unionAll(spark.createDataFrame([(11, 99, 3.0)], R))
    a = labels(spark)
    gray, cluster = {r.user_id: r.is_gray for r in a.collect()}, {r.user_id: r.cluster_id for r in a.collect()}
    got = {(r.user_id, r.item_id): r.pred for r in neighbours.knn(train, test, a, kernel, 3, "white" if white else "all", False).collect()}
    want = brute_knn(table(train), table(test), cluster, gray, low, 3, white)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_routing_and_lists(spark):
    every, a = ratings(spark), labels(spark)
    with pytest.raises(ValueError):
        neighbours.routed(every, every, a, gray="none")
    with pytest.raises(ValueError):
        neighbours.pair_similarity(every, every.select(F.col("user_id").alias("u"), F.col("user_id").alias("v")), "none")
    items = spark.createDataFrame([(i,) for i in range(12)], "item_id long")
    left = {(r.user_id, r.item_id) for r in neighbours.unseen(every, a, items).collect()}
    assert left == {(u, i) for u in range(12) for i in range(12)} - set(table(every))
    lists = neighbours.recommend(every, a.where("user_id < 3"), items, lambda t: predict.item_fallback_plain(every, t), 4).collect()
    assert {r.user_id for r in lists} == {0, 1, 2} and all(1 <= r.rank <= 4 for r in lists)
    done = neighbours.routed(every, every, a, "fallback")
    assert done.count() == every.count()


def test_profiles_and_empty_evaluation(spark):
    train = spark.createDataFrame([(1, 1, 3.0), (1, 2, 4.0), (2, 1, 3.0), (2, 2, 4.0), (3, 1, 5.0)], R)
    a = spark.createDataFrame([(1, 7, False), (2, 8, False), (3, 9, False)], "user_id long, cluster_id long, is_gray boolean")
    asked = spark.createDataFrame([(10, 2, 4.0), (10, 1, 3.0), (11, 1, 5.0), (12, 1, 4.0)], "id long, item_id long, rating double")
    assert {r.id: r.cluster_id for r in neighbours.label_of_profiles(asked, train, a).collect()} == {10: 7, 11: 9, 12: None}
    row = neighbours.evaluate_cf(train, train.limit(0), lambda t: neighbours.knn(train, t, a), train).first()
    assert (row.n, row.users, row.precision, row.recall) == (0, 0, 0.0, 0.0)


# ---- clusters of users


def test_masked_lloyd_against_numpy(spark):
    df, k = ratings(spark, 15, 8, 3), 3
    m = np.zeros((15, 8))
    for (u, i), r in table(df).items():
        m[u, i] = r
    c, before = m[:k].copy(), None
    for _ in range(6):
        d = np.full((15, k), ratings_clusters.FAR)
        for u in range(15):
            for j in range(k):
                both = (m[u] != 0) & (c[j] != 0)
                if both.any():
                    d[u, j] = round(float(np.sqrt(((m[u] - c[j])[both] ** 2).sum())), 6)
        lab = d.argmin(1)
        if before is not None and (lab == before).all():
            break
        before = lab
        c = np.array([m[lab == j].mean(0) if (lab == j).any() else c[j] for j in range(k)])
    _, got = ratings_clusters.lloyd(df, ratings_clusters.user_centres(df, [0, 1, 2]), k, 6)
    assert {r.user_id: r.cluster_id for r in got.collect()} == dict(enumerate(lab.tolist()))


def test_mk_means(spark):
    df = ratings(spark, 14, 8, 5)
    chosen = ratings_clusters.seed_users(df, 4)
    assert len(set(chosen)) == 4 and chosen == ratings_clusters.seed_users(df, 4)
    weight = {r.user_id: round(r.weight, 6) for r in ratings_clusters.power_weights(df).collect()}
    assert weight[chosen[0]] == max(weight.values())
    _, got = ratings_clusters.mk_means(df, 3, 5)
    assert got.count() == 14 and {r.cluster_id for r in got.collect()} <= {0, 1, 2}
    one, two = ratings_clusters.mk_population(df, 2, 2, 2)
    assert one.select("cluster_id").distinct().count() == 2 and sorted(map(tuple, one.collect())) != sorted(map(tuple, two.collect()))
    for k in (0, 15):
        with pytest.raises(ValueError):
            ratings_clusters.seed_users(df, k)
    with pytest.raises(ValueError):
        ratings_clusters.mk_population(df, 2, 0)


def test_empty_cluster_gets_a_user(spark):
    df = ratings(spark, 10, 6, 7)
    far = spark.createDataFrame([(0, i, 3.0) for i in range(6)] + [(1, 77, 1.0)], "cluster_id long, item_id long, value double")
    centres, got = ratings_clusters.lloyd(df, far, 2, 2)
    assert centres.select("cluster_id").distinct().count() == 2 and got.count() == 10


def test_assignment_manager(spark):
    a = labels(spark)
    none = ratings_clusters.Assignment(3)
    with pytest.raises(RuntimeError):
        none.members(0)
    loaded = ratings_clusters.Assignment(3).load(a, a.select("user_id", "is_gray"))
    assert loaded.cluster_of(4) == 1 and {r.user_id for r in loaded.members(1).collect()} == {1, 4, 7, 10}
    assert {r.user_id for r in loaded.gray_members(1).collect()} == {10} and loaded.white_members(1).count() == 3
    s = ratings_clusters.Assignment(5).load(a).summary().first()
    assert (s.smallest, s.largest, s["mean"], s.empty) == (0, 4, 2.4, 2)
    with pytest.raises(ValueError):
        ratings_clusters.Assignment(1).load(a)
    with pytest.raises(ValueError):
        loaded.load(a.limit(0))
    with pytest.raises(ValueError):
        loaded.load(a, a.where("user_id < 5").select("user_id", "is_gray"))
    df = ratings(spark)
    fitted = ratings_clusters.Assignment(2).fit(df, ratings_clusters.user_centres(df, [0, 1]), "euclid")
    assert fitted.cluster_of(0) == 0 and fitted.cluster_of(1) == 1
    with pytest.raises(RuntimeError):
        fitted.gray_members(0)


def test_rating_metrics_against_numpy(spark):
    df, a = ratings(spark), labels(spark)
    centres = ratings_clusters.mean_centres(df, a)
    row = ratings_clusters.all_metrics(df, centres, a, 3).first()
    m = np.zeros((12, 9))
    for (u, i), r in table(df).items():
        m[u, i] = r
    c = np.array([m[[u for u in range(12) if u % 3 == j]].mean(0) for j in range(3)])

    def far(x, y, low=2.0):
        both = (x != 0) & (y != 0)
        p, q = x[both] - x[both].mean() if both.any() else x[:0], y[both] - y[both].mean() if both.any() else y[:0]
        d = np.linalg.norm(p) * np.linalg.norm(q)
        return 1 - float(p @ q / d) if both.sum() >= 2 and d > 1e-10 else low

    sil = []
    for u in range(12):
        mean = {j: np.mean([far(m[u], m[v]) for v in range(12) if v % 3 == j and v != u]) for j in range(3)}
        x, y = mean[u % 3], min(mean[j] for j in range(3) if j != u % 3)
        sil.append((y - x) / max(x, y))
    assert abs(row.silhouette - np.mean(sil)) < 1e-5 and (row.smallest, row.largest, row.empty) == (4, 4, 0)
    s = [np.mean([far(m[u], c[j]) for u in range(12) if u % 3 == j]) for j in range(3)]
    db = np.mean([max((s[i] + s[j]) / far(c[i], c[j]) for j in range(3) if j != i) for i in range(3)])
    assert abs(row.davies_bouldin - db) < 1e-4


def test_outlier_threshold(spark):
    scored = spark.createDataFrame([(1, 1.0), (2, 1.4), (3, 1.8), (4, 3.0)], "vec_id long, lof double")
    row = ratings_clusters.outlier_threshold(scored).first()
    assert (row.gray_count, row.gray_ratio, row.threshold) == (2, 0.5, 1.6)


# ---- factor models


def test_biased_and_probabilistic_models(spark):
    df = ratings(spark, 30, 20, 1)
    shifted = df.withColumn("user_id", F.col("user_id") + (1 << 40))  # ids beyond 32 bits
    asked = shifted.unionAll(spark.createDataFrame([(5, 1, 3.0)], R))
    for fit in (factorize.biased, factorize.probabilistic):
        out = fit(shifted, asked, rank=4, rounds=4).collect()
        assert len(out) == asked.count() and all(1 <= r.pred <= 5 for r in out)
        assert np.mean([abs(r.pred - r.rating) for r in out]) < 1.2
    mu = df.agg(F.avg("rating")).first()[0]
    lost = factorize.als(df, spark.createDataFrame([(99, 99, 3.0)], R), 3, 2, non_negative=False).first()
    assert abs(lost.pred - mu) < 1e-9


def test_spectral_start_against_svd(spark):
    df = ratings(spark, 10, 7, 4)
    m = np.full((10, 7), df.agg(F.avg("rating")).first()[0])
    for (u, i), r in table(df).items():
        m[u, i] = r
    left, s, right = np.linalg.svd(m)
    users, items = factorize.spectral_start(df.select("user_id", "item_id", "rating"), 2, 12)
    p = np.array([r.p for r in users.orderBy("user_id").collect()])
    q = np.array([r.q for r in items.orderBy("item_id").collect()])
    assert np.allclose(p[:, 0], np.abs(left[:, 0] * s[0]), atol=1e-3) and np.allclose(q[:, 0], np.abs(right[0] * s[0]), atol=1e-3)
    with pytest.raises(ValueError):
        factorize.wnmf(df, init="none")


def test_wnmf_stops_and_fits(spark):
    df = ratings(spark, 10, 7, 4)
    e = lambda f: f.predict(df).agg(F.avg(F.abs(F.col("pred") - F.col("rating")))).first()[0]
    assert e(factorize.fit_factors(df, rank=3, rounds=12)) < e(factorize.fit_factors(df, rank=3, rounds=1))
    f = factorize.fit_factors(df, rank=2, rounds=3, tolerance=1e9, every=1)
    assert f.users.count() == 10 and f.recommend(df, df.where("user_id = 0"), 2).count() <= 2


def test_tuning(spark):
    df = ratings(spark, 12, 10, 2)
    bounds = {"n_components": (1, 3), "alpha": (0.0, 0.1)}
    score = factorize.tuning_objective(df, "wnmf", bounds, {"rounds": 2})
    y = score(np.array([[0.2, 0.0], [0.2, 1.0]]))
    assert y.shape == (2,) and (y > 0).all()
    best, error = factorize.tune(df, "wnmf", bounds, size=2, epochs=1, fixed={"rounds": 2})
    assert 1 <= best["n_components"] <= 3 and error <= 5
    assert factorize.tuning_objective(df.limit(0), "wnmf", bounds)(np.zeros(2)).tolist() == [10.0]
    with pytest.raises(ValueError):
        factorize.get_model("none")


def test_gray_models_and_blend(spark):
    df = ratings(spark, 20, 8, 6).join(labels(spark, 20), "user_id")
    solve = factorize.Rule.biased_model(rank=2, epochs=3)
    gray = factorize.gray_models(df, df, solve)
    assert {r.user_id for r in gray.select("user_id").distinct().collect()} == {0, 5, 10, 15}
    assert factorize.gray_models(df.where("user_id > 0"), df.limit(0), solve).count() == 0
    _, items = factorize.wnmf(df, rank=2, rounds=2)
    assert factorize.gray_shared(df, df, items, 2).count() == df.where("is_gray").count()
    profiles = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cluster_id long, p_k array<double>")
    q = spark.createDataFrame([(1, [2.0, 4.0])], "item_id long, q array<double>")
    new = spark.createDataFrame([(7, 1, 3.0), (8, 1, 3.0)], R)
    own = spark.createDataFrame([(7, 0), (8, 1)], "user_id long, cluster_id long")
    members = spark.createDataFrame([(7, 0, 0.25), (7, 1, 0.25), (8, 0, 0.0)], "user_id long, cluster_id long, w double")
    assert {r.user_id: r.pred for r in factorize.blended(new, profiles, q, members, own).collect()} == {7: 3.0, 8: 4.0}


# ---- search


@pytest.mark.parametrize("name", [*sorted(search.SINGLE), "GWO+PSO", "HHO+GAop", "PSO||DE"])
def test_every_search_improves(name):
    f = lambda p: ((p - 0.3) ** 2).sum(1)
    low, high = -np.ones(4), np.ones(4)
    r = search.get_optimizer(name)(f, low, high, 12, 24, 3)
    assert r.fitness < 0.2 and (r.best >= -1).all() and (r.best <= 1).all()
    assert all(b <= a + 1e-12 for a, b in zip(r.history, r.history[1:], strict=False)) or "+" in name or "||" in name or name == "GWO-PSO"
    assert abs(float(f(r.best[None])[0]) - r.fitness) < 1e-6


def test_donors_are_others():
    s = search.Search(lambda p: p.sum(1), np.zeros(2), np.ones(2), 9, 1)
    for _ in range(20):
        a, b, c = search.donors(s)
        for n in range(9):
            assert len({tuple(s.x[n]), tuple(a[n]), tuple(b[n]), tuple(c[n])}) == 4


def test_hybrids_and_choices():
    low = lambda p: p.sum(1)
    assert search.get_optimizer("PSO||PSO")(low, np.zeros(2), np.ones(2), 5, 3).fitness == search.pso(low, np.zeros(2), np.ones(2), 5, 3).fitness
    rows = [{"algorithm": "a", "final_wcss": 2.0, "category": "GLOBAL", "exploration_ratio": 0.1, "time": 1.0}, {"algorithm": "b", "final_wcss": 1.0, "category": "LOCAL", "exploration_ratio": 0.5, "time": 2.0}, {"algorithm": "c", "final_wcss": 3.0, "category": "BALANCED", "exploration_ratio": 0.9, "time": 0.5}]
    assert search.choose_hybrid(rows) == ("a", "b")
    assert search.choose_hybrid([r | {"category": "BALANCED"} for r in rows]) == ("c", "a")
    x = search.multi_start(low, lambda seeds: [np.random.RandomState(s).rand(2) for s in seeds], 8, 5)
    assert len(x) == 15 and (np.diff(low(x)) >= 0).all()


# ---- assignments, runners, store


def test_names_and_suffixes(spark):
    assert assignments.choose(["kmeans", "B1_HHO", "hho", "LIT_GWO"]) == ["B0_KMEANS", "B1_HHO", "LIT_GWO"]
    assert assignments.choose(["kmeans", "GWO"], prefixes=("LIT",)) == ["LIT_GWO"] and assignments.choose(["GWO"], banned=("LIT_GWO",)) == []
    with pytest.raises(KeyError):
        assignments.choose(["nothing"])
    rows = spark.createDataFrame([("a",), ("b",)], "name string")
    with pytest.raises(KeyError):
        assignments.check_known(rows, rows.where("name = 'a'"))
    assert assignments.suffix({"min_user": 5, "min_item": 10, "zscore": True, "pca": 0.95}) == "prune_u5_i10_zscore_pca95pct"
    assert reports.sync_suffix("a_wnmf20_b_wnmf3", 16) == "a_wnmf16_b_wnmf3"
    assert reports.preprocessing_candidates("prune_u5_wnmf20_inmed_trim5_95") == ["prune_u5_wnmf20_inmed_trim5_95", "prune_u5_wnmf20", "prune_u5"]
    assert reports.grid(a=[1, 2], b=[3]) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]
    name = spark.createDataFrame([("ML-100k ",)], "x string").select(scalars.dataset_name(F.col("x")), scalars.experiment_id(F.lit("a"), F.lit(1))).first()
    assert tuple(name) == ("ml100k", "a__1")


def test_features_bounds_and_clusterings(spark):
    df = ratings(spark, 15, 8, 2)
    v, d = assignments.features(df, {"zscore": True, "unit": True})
    assert d == 8 and all(abs(sum(x * x for x in r.vals) - 1) < 1e-9 for r in v.collect())
    v, d = assignments.features(df, {"zscore": True, "pca": 3})
    assert d == 3 and len(v.first().v) == 3
    v, d = assignments.features(df, {"factors": 2, "rounds": 2})
    assert d == 2 and v.count() == 15
    with pytest.raises(ValueError):
        assignments.features(df, {"factors": 2, "pca": 2})
    same = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, v array<double>")
    assert [x[0] for x in assignments.bounds(same, 1, 2)] == [-1.0, 1.0] and [x[0] for x in assignments.bounds(same, 1, 2, "raw")] == [1.0, 5.0]
    assert [x[0] for x in assignments.bounds(v, 2, 2, "search")][0] == 0.0 and [x[0] for x in assignments.bounds(v, 1, 2, "centred")] == [-4.0, 4.0]
    for name in ("kmeans", "fcm", "meta_PSO"):
        near, centres = assignments.Clustering(name, 3, 2, rounds=3, size=4, epochs=2).fit_predict(v)
        assert near.count() == 15 and centres.count() == 3
    with pytest.raises(ValueError):
        assignments.Clustering("none", 3, 2).fit_predict(v)
    with pytest.raises(ValueError):
        assignments.Clustering("kmeans", 3, 2).fit_predict(v.limit(0))
    p = assignments.Problem(v, 2, 2)
    assert p.dim == 4 and p.starts(2).shape == (2, 4) and p.fitness(p.starts(2)).shape == (2,)


def test_assignments_scenarios_and_store(spark, tmp_path):
    df, st = ratings(spark, 15, 10, 2), store.Store(spark, str(tmp_path / "store"))
    how = {"factors": 2, "rounds": 2}
    rows = experiment.produce_assignments(spark, st, df, "toy", ["kmeans", "PSO"] if "PSO" in assignments.ALGORITHMS else ["kmeans", "GWO"], 2, how, 4, 2)
    assert rows.count() == 2 and st.read("labels").count() == 30 and "B0_KMEANS" in st.listing()
    row = rows.where("algo = 'B0_KMEANS'").first()
    assert row.n_users == 15 and row.gray_count + row.cluster_avg * (1 if row.cluster_min == row.cluster_max and row.gray_count == 15 - row.cluster_avg else 2) <= 30
    out = experiment.run_scenarios(spark, st, df, "toy", "B0_KMEANS", 2, ["none", assignments.suffix(how)], [{"rank": 2, "rounds": 1, "epochs": 1}], 2)
    assert {r.scenario for r in out.collect()} == {"global", "cluster_full", "cluster_sharedV", "cluster_avg", "cluster_knn"} and {r.fold for r in out.collect()} == {0, 1}
    assert experiment.cv_means(out).count() == 5 and st.read("wnmf_results").count() == 10
    done = spark.createDataFrame([(2, "k2_ld2_eg1_ec1", False)], "k long, tag string, svdpp boolean")
    assert experiment.run_scenarios(spark, st, df, "toy", "B0_KMEANS", 2, [assignments.suffix(how)], [{"rank": 2, "rounds": 1, "epochs": 1}], done=done).count() == 0
    with pytest.raises(LookupError):
        experiment.run_scenarios(spark, st, df, "toy", "B0_KMEANS", 9, ["none"])
    assert {r.status for r in st.runs().collect()} <= {"done", "skipped", "running"}
    assert st.save_result("toy", "nobody", 1, "none", "x", mae=1.0) is None
    with pytest.raises(RuntimeError):
        st.create(recreate=True)
    st.create()
    assert not st.has_rows("behaviour")
    done, lists, table_ = experiment.recommendations(df, st.labels(row.id).select("user_id", "cluster_id", "is_gray"), 3)
    assert {"mixed"} <= {r.segment for r in table_.collect()} and lists.where("rank > 3").count() == 0
    reports.write_evaluation(table_, str(tmp_path / "ev"))
    text = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "ev" / "evaluation_json")).collect()]
    assert {"mixed"} <= {t["segment"] for t in text}
    assert spark.read.csv(str(tmp_path / "ev" / "evaluation_csv"), header=True).columns == list(reports.EVALUATION)


def test_screening(spark, tmp_path):
    df = ratings(spark, 15, 8, 2)
    v, d = assignments.features(df, {"factors": 2, "rounds": 2})
    v = clusters.cut(v)
    st = store.Store(spark, str(tmp_path / "s"))
    out = experiment.screening(spark, st, v, ["B0_KMEANS", "PSO", "LIT_GWO", "nothing"], 2, d, 2, 4, 3)
    assert out["runs"].count() == 8 and {r.algorithm for r in out["failed"].collect()} == {"nothing"}
    assert {r.algorithm for r in out["best"].collect()} == {"B0_KMEANS", "PSO", "LIT_GWO"} and st.has_rows("behaviour")
    assert {r.algorithm for r in out["behaviour"].collect()} == {"PSO", "LIT_GWO"}
    one, two = assignments.select_hybrid(out["behaviour"])
    assert {one, two} == {"PSO", "LIT_GWO"}
    late, _ = assignments.screening_row(v, "B0_KMEANS", 0, 2, d, 4, 2, 1, limit=0.0)
    assert late[2] is False and "TimeoutError" in late[-1]
    rows, _ = assignments.screen(v, ["B0_KMEANS"], 2, d, 3, stop_after=-1.0)
    assert rows.count() == 0
    sweep = experiment.k_sweep(v, d, [2, 3], 3).collect()
    assert sweep[0].wcss >= sweep[1].wcss
    assert assignments.five_minutes()["stop_after"] == 300.0 and assignments.sample_of(v, 3).count() == 3


def test_experiment_and_command(spark, sf, tmp_path):
    df = ratings(spark, 14, 10, 8)
    config = experiment.settings(overrides=["data.folds=2", "clustering.k=2", "model.rounds=2", "model.n_components=2", "clustering.rounds=2", "evaluation.at_n=[3]"])
    names = {r.metric for r in experiment.run_experiment(spark, df, config).collect()}
    assert names == {"mae", "rmse", "precision@3", "recall@3", "f1@3", "ndcg@3"}
    both = experiment.run_all(spark, df, config, reports.grid(**{"recommender.kind": ["mf", "cluster_average"], "clustering.space": ["raw"]}))
    assert both.where("metric = 'mae' AND value > 0").count() == 4
    with pytest.raises(ValueError):
        experiment.SPACES.get("none")
    row = experiment.clustering_cf(df, 2, 2).first()
    assert row.n > 0 and 0 <= row.precision <= 1
    st = str(tmp_path / "store")
    assert "wcss" in experiment.command(spark, ["assign", "--data", sf, "--store", st, "--k", "2", "--epochs", "2", "--factors", "2"])
    assert "B0_KMEANS" in experiment.command(spark, ["assignments", "--store", st]) and "done" in experiment.command(spark, ["runs", "--store", st])


# ---- reports, sinks and readers


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", "s", "mae", 1.0), ("a", "t", "rmse", 2.0)], "algorithm string, segment string, metric string, value double")
    assert {tuple(r) for r in reports.comparison(rows, ("mae", "rmse")).collect()} == {("a", "s", "1.0", ""), ("a", "t", "", "2.0")}
    reports.write_comparison(rows, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    (tmp_path / "algo").mkdir()
    (tmp_path / "algo" / "sum.json").write_text(json.dumps({"white": {"mae": 0.5}}))
    assert tuple(reports.read_comparison(spark, f"{tmp_path}/*/sum.json").first()) == ("algo", "white", "mae", 0.5)
    text = reports.text_table(spark.createDataFrame([(1, 0.5, None)], "a int, b double, c string"))
    assert text.splitlines()[-1].split() == ["1", "0.5000"]
    log = reports.logger("x-test")
    assert len(reports.logger("x-test").handlers) == 1 and log is reports.logger("x-test")
    assert all("k=5" in p for p in reports.result_paths("r", "d", 5)) and "holdout" in reports.result_paths("r", "d", cross_validated=False)[0]
    r = reports.Report(spark)
    r.add("a", mae=1, rmse=2)
    assert tuple(r.wide("mae", "rmse").first()) == ("a", 1.0, 2.0)
    jobs = spark.createDataFrame([(1, "t", True), (2, "u", False)], "k long, tag string, svdpp boolean")
    assert reports.missing_tags(jobs, jobs.where("k = 1")).count() == 1 and reports.missing_tags(jobs, None).count() == 2 and reports.missing_tags(jobs, jobs.select("k")).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None), (2, "y", 0.5)], "a long, b string, c double")
    sinks.write_csv(df, str(tmp_path / "csv"), "run me")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).where("command = 'run me'").count() == 2
    sinks.write_csv(df.limit(0), str(tmp_path / "none"))
    assert spark.read.option("header", True).schema("a long").csv(str(tmp_path / "none")).count() == 0
    sinks.write_json(df, str(tmp_path / "json"))
    assert {json.loads(r.value)["a"] for r in spark.read.text(str(tmp_path / "json")).collect()} == {1, 2}
    both = sinks.append_rows(df, spark.createDataFrame([(3, True)], "a long, d boolean"))
    assert both.columns == ["a", "b", "c", "d"] and both.count() == 3
    a = spark.createDataFrame([("d", "x", 2, 1, 0)], "dataset string, algo string, k long, user_id long, cluster_id long")
    sinks.write_assignments(a, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "assignments")).where("dataset = 'd' AND k = 2").count() == 1
    sinks.write_recommendations(df, df, df.limit(1), str(tmp_path / "rec"))
    assert spark.read.parquet(str(tmp_path / "rec" / "predictions")).count() == 2
    sinks.write_phase(spark.createDataFrame([("a", True), ("b", False)], "algorithm string, success boolean"), str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "phase")).where("NOT success").count() == 1


def test_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text, encoding="latin-1")
        return str(tmp_path / name)

    for n in ("u1.base", "u1.test"):
        put(n, "1\t10\t3\t9\n2\t11\t4\t9\n")
    base, test = readers.read_ratings_100k(spark, str(tmp_path))
    assert {tuple(r)[:3] for r in base.collect()} == {(0, 9, 3.0), (1, 10, 4.0)} == {tuple(r)[:3] for r in test.collect()}
    flags = "|".join(["1"] + ["0"] * 17 + [""])
    movies = readers.read_movies_100k(spark, put("u.item", f"1|A|x|y|z|{flags}\n99|B|x|y|z|{flags}\n3|short\n"), 50).collect()
    assert len(movies) == 1 and movies[0].genres == [1] + [0] * 18
    users = readers.read_users_1m(spark, put("users.dat", "1::M::56::20::z\n2::F:: ::3::z\n")).orderBy("user_id").collect()
    assert users[0].male == 1 and users[0].age == 1.0 and users[0].occupation[20] == 1 and abs(users[1].age - 25 / 56) < 1e-12
    assert readers.read_filmtrust(spark, put("ratings.txt", "1\t2\t3.5\n1::3::4\n1 4 5\n")).count() == 3
    summary = readers.read_summary(spark, put("s.json", '{"white": {"mae": 1.5}}')).first()
    assert tuple(summary) == ("white", "mae", 1.5)
    results = readers.read_results(spark, put("r.csv", "# command: x\nk,mae\n3,0.5\n"))
    assert tuple(results.first()) == (3, 0.5)
    both = readers.read_assignments(spark, put("a.csv", "user_idx,cluster_id,is_gray_sheep\n0,2,1\n1,3,0\n"), spark.createDataFrame([(1, True)], "user_id long, is_gray boolean"))
    assert {tuple(r) for r in both.collect()} == {(0, 2, True), (1, 3, True)}
    with pytest.raises(ValueError):
        readers.check_same_users(both, both.where("user_id = 0"))
    readers.check_same_users(both, both)
    for n, extra in ((1, ""), (2, ",gray"), (10, "")):
        (tmp_path / "runs" / str(n)).mkdir(parents=True)
        put(f"runs/{n}/out.csv", f"algorithm,wcss{extra}\na,{n}{',5' if extra else ''}\n")
    runs = readers.read_runs(spark, str(tmp_path / "runs"))
    assert [(r.run_num, float(r.wcss), r.gray) for r in runs.orderBy("run_num").collect()] == [(1, 1.0, None), (2, 2.0, 5), (10, 10.0, None)]
    assert readers.next_run_number(str(tmp_path / "runs")) == 11 and readers.next_run_number(str(tmp_path / "nothing")) == 1
    assert readers.first_existing([str(tmp_path / "nothing"), str(tmp_path / "s.json")]).endswith("s.json")
    with pytest.raises(FileNotFoundError):
        readers.first_existing([str(tmp_path / "nothing")])
    loaded, users_, items = readers.load_dense(spark, [str(tmp_path / "nothing"), put("dense.dat", "5::7::3\n9::7::4\n")])
    assert {tuple(r) for r in loaded.collect()} == {(0, 0, 3.0), (1, 0, 4.0)} and users_.count() == 2 and items.count() == 1


def test_normal_states(spark):
    df = ratings(spark, 6, 5, 1)
    for how in ("global_mean", "zscore", "user_mean", "user_zscore", "zscore_guarded"):
        state = prepare.scale_state(df, how)
        z = table(prepare.apply_scale(df, state))
        want = {(r.user_id, r.item_id): r.z for r in prepare.normalize(df, how).collect()}
        assert all(math.isclose(z[x], want[x], abs_tol=1e-12) for x in want)
    with pytest.raises(ValueError):
        prepare.scale_state(df, "none at all")


@pytest.mark.parametrize("block", [2048, 16])
def test_k_nearest_against_brute_force(spark, block):
    """Coincident vectors and ties included; many small cells or one block: the same."""
    draw = np.random.RandomState(1)
    x = np.round(draw.rand(120, 3) * 4) / 4
    x[50:60] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    got = {}
    for r in clusters.k_nearest(df, 5, block).collect():
        got.setdefault(r.id, []).append((r.dist, r.other))
    for i in range(120):
        d = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in range(120) if j != i)[:5]
        assert sorted(got[i]) == d
    assert clusters.k_nearest(df.limit(0), 5).count() == 0


def shuffled(spark, run) -> int:
    """Rows that the stages of ``run`` wrote to shuffles."""
    sc = spark.sparkContext
    store, gateway = sc._jsc.sc().statusStore(), sc._gateway

    def stages() -> dict[int, int]:
        found = store.stageList(gateway.jvm.java.util.ArrayList(), False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(rows for stage, rows in stages().items() if stage not in before)


def test_k_nearest_shuffles_in_proportion(spark):
    """Vectors without structure, where every block is asked: the rows shuffled stay in proportion to the vectors, and parts of the streamed side agree."""
    x = np.random.RandomState(2).rand(600, 16)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>").repartition(4).cache()
    df.count()
    got = {}
    assert shuffled(spark, lambda: got.update({0: sorted(map(tuple, clusters.k_nearest(df, 5, 16).collect()))})) < 600 * 5 * 3
    assert sorted(map(tuple, clusters.k_nearest(df, 5, 64, stretch=200).collect())) == got[0] and len(got[0]) == 3000
    for i in range(0, 600, 50):
        d = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in range(600) if j != i)[:5]
        assert sorted((d_, j) for k, j, d_ in got[0] if k == i) == d


@pytest.mark.parametrize("block", [4096, 3])
def test_pair_sums_in_blocks(spark, block, monkeypatch):
    from tastemill.operators import kernels

    df = ratings(spark, 12, 5, 9)
    plain = sorted(map(tuple, kernels.pair_sums(df).select("u", "v", "n", "sxy").collect()))
    monkeypatch.setattr(kernels, "BLOCK", block)
    monkeypatch.setattr(kernels, "SMALL_ROWS", 0)
    assert sorted(map(tuple, kernels.pair_sums(df).select("u", "v", "n", "sxy").collect())) == plain
    assert sorted(map(tuple, kernels.pair_sums(df, labels(spark)).select("u", "v", "n", "sxy").collect())) == [p for p in plain if p[0] % 3 == p[1] % 3]


def test_evaluation_helpers(spark):
    df = ratings(spark)
    predictor = lambda t: predict.item_fallback_plain(df, t)
    done = neighbours.rating_errors(df, predictor)
    assert done.columns == ["rating", "pred"] and neighbours.regression_errors(done).first().n == df.count()
    row = neighbours.ranking_of_rows(predictor(df), 3).first()
    assert 0 < row.precision <= 1 and 0 < row.ndcg <= 1


def test_distinct_events(spark, sf, tmp_path):
    from tastemill.streaming import ratings_feed

    events = spark.read.parquet(f"{sf}/events.parquet").limit(50)
    for _ in range(2):
        events.write.mode("append").parquet(str(tmp_path / "in"))
    feed = ratings_feed.distinct_events(ratings_feed.read_feed(spark, str(tmp_path / "in")), "100 days")
    ratings_feed.append_to(feed, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
