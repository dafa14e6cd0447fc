"""Sparse vectors against dense ones, composite scores, and the choices of an assignment run."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.operators import clusters, factorize, search, sparse
from tastemill.plans import assignments

R = "user_id long, item_id long, rating double"


def cells(n=24, d=9, seed=1):
    draw = random.Random(seed)
    return [(u, i, float(draw.randrange(1, 6))) for u in range(n) for i in range(d) if draw.random() < 0.5]


@pytest.fixture(scope="module")
def both(spark):
    rows = cells()
    df = sparse.from_cells(spark.createDataFrame(rows + [(77, 0, 0.0)], "vec_id long, dim long, value double")).repartition(3).cache()
    dense = {}
    for u, i, r in rows + [(77, 0, 0.0)]:
        dense.setdefault(u, [0.0] * 9)[i] = r
    return df, spark.createDataFrame(sorted(dense.items()), "vec_id long, v array<double>").cache()


def plain(df, *names):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in (r[n] for n in names)) for r in df.collect())


@pytest.mark.parametrize("small", [sparse.SMALL, 0])
def test_distances_and_lloyd_as_dense(spark, both, monkeypatch, small):
    monkeypatch.setattr(sparse, "SMALL", small)
    monkeypatch.setattr(sparse, "STEP", 16)
    df, dense = both
    start = clusters.seed_by_distance(dense, 4, "s")
    seeds = sparse.seed_by_distance(df, 4, 9, "s")
    table = np.zeros((4, 9))
    for r in seeds.collect():
        table[r.cluster_id, r.dim] = r.value
    assert np.allclose(table, start)
    centres, near = sparse.lloyd(df, seeds, 4, 9, 6)
    found, wanted = clusters.lloyd(dense, start, 9, 6)
    assert plain(near, "vec_id", "nearest", "d2") == plain(wanted, "vec_id", "nearest", "d2")
    for r in centres.collect():
        assert abs(found[r.cluster_id][r.dim] - r.value) < 1e-9


def test_empty_centroid_and_fuzzy_as_dense(spark, both):
    df, dense = both
    start = [[1.0] * 9, [50.0] * 9, [2.0] * 9]
    table = spark.createDataFrame([(c, i, x) for c, row in enumerate(start) for i, x in enumerate(row)], "cluster_id long, dim int, value double")
    _, near = sparse.lloyd(df, table, 3, 9, 4)
    _, wanted = clusters.lloyd(dense, start, 9, 4)
    assert plain(near, "vec_id", "nearest") == plain(wanted, "vec_id", "nearest")
    centres, w = sparse.fuzzy_c_means(df, 3, 9, 4)
    far, _ = clusters.fuzzy_c_means(dense, 3, 9, 4)
    want = {r.cluster_id: r.c for r in far.collect()}
    got = np.zeros((3, 9))
    for r in centres.collect():
        got[r.cluster_id, r.dim] = r.value
    assert np.allclose(got, [want[i] for i in range(3)], atol=1e-9)
    assert plain(w, "vec_id", "cluster_id", "w") == plain(clusters.memberships(dense, far).withColumnRenamed("cid", "cluster_id"), "vec_id", "cluster_id", "w")


def test_pca_as_dense(spark, both):
    df, dense = both
    for how in ({"k": 3}, {"variance": 0.8}, {"k": 2, "whiten": True}):
        got, share = factorize.pca_sparse(df, 9, **how)
        want, shares = factorize.pca(dense, d=9, **how)
        assert np.allclose(share, shares)
        a, b = (np.array([r.v for r in x.orderBy("vec_id").collect()]) for x in (got, want))
        assert np.allclose(np.abs(a), np.abs(b), atol=1e-7)


def test_features_have_no_grid(spark):
    df = spark.createDataFrame(cells(15, 8), R)
    for how in ({}, {"zscore": True, "unit": True}):
        out, d = assignments.features(df, how)
        assert d == 8 and out.columns == ["vec_id", "ids", "vals"]
        assert "sequence" not in out._jdf.queryExecution().toString().lower()
        assert sum(len(r.ids) for r in out.collect()) == df.count()
    out, d = assignments.features(df, {"zscore": True, "pca": 3})
    assert d == 3 and len(out.first().v) == 3
    raw, d = assignments.features(df, {})
    for name in ("kmeans", "fcm", "meta_GWO"):
        near, centres = assignments.Clustering(name, 3, d, rounds=3, size=4, epochs=2, space="raw").fit_predict(raw)
        assert near.count() == 15 and near.where("nearest > 2").count() == 0
    low, high = assignments.bounds(raw, 1, d)
    assert low[0] < 0 < 4 < high[0]


def test_composite_by_hand(spark):
    draw = np.random.RandomState(3)
    x = draw.randn(40, 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    score = search.Composite(df, 2, 3)
    population = draw.randn(3, 6)
    wanted = []
    for c in population.reshape(3, 2, 3):
        d2 = ((x[:, None] - c) ** 2).sum(2)
        own = d2.argmin(1)
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        far = 1 - unit @ unit.T
        sil = []
        for i in range(40):
            inner, outer = far[i][(own == own[i]) & (np.arange(40) != i)], far[i][own != own[i]]
            sil.append(0 if not len(inner) else (outer.mean() - inner.mean()) / max(outer.mean(), inner.mean()))
        groups = [x[own == g] for g in (0, 1)]
        between = sum(len(g) * ((g.mean(0) - x.mean(0)) ** 2).sum() for g in groups)
        within = sum(((g - g.mean(0)) ** 2).sum() for g in groups)
        wanted.append((d2.min(1).sum(), np.mean(sil), between / (within / 38)))
    assert np.allclose(score.parts(population), wanted)
    w, s, c = np.array(wanted).T
    assert np.allclose(score(population), 0.5 * w / w[0] + 0.25 * (1 - s) / (1 - s[0]) + 0.25 * c[0] / c)
    assert abs(score(population[:1])[0] - 1) < 1e-12  # the base stays the first that was seen
    assert score.quality(np.array([[0.0] * 3, [99.0] * 3])) == (-1.0, 1.0)


def test_run_settings(spark):
    ratings = spark.createDataFrame(cells(30, 10, 4), R)
    vectors, d = assignments.features(ratings, {"factors": 2, "rounds": 2})
    vectors = clusters.cut(vectors)
    one = assignments.run_one(vectors, "LIT_GWO", 3, d, 4, 3, objective="composite", gray="lof", ratings=ratings, neighbours=5, contamination=0.2, members=True)
    rows = one["labels"].collect()
    gray = [r for r in rows if r.is_gray]
    assert len(rows) == 30 and 1 <= len(gray) <= 7 and all(r.cluster_id == 3 for r in gray)
    assert max(r.dist for r in rows if not r.is_gray) <= one["threshold"] <= min(r.dist for r in gray)
    assert one["history"][0] <= 1.0 + 1e-9 and one["wcss"] > 0
    shares = one["members"].groupBy("vec_id").agg(F.sum("w").alias("s")).collect()
    assert len(shares) == 30 and all(abs(r.s - 1) < 1e-9 for r in shares)
    raw, d = assignments.features(ratings, {})
    for label in ("B0_KMEANS", "B1_HHO"):
        r = assignments.run_one(raw, label, 2, d, 3, 2, gray="percentile", members=True)
        assert r["labels"].count() == 30 and 0 < r["labels"].where("is_gray").count() <= 6 and r["members"].count() == 60
    with pytest.raises(ValueError):
        assignments.run_one(vectors, "B0_KMEANS", 2, 2, gray="lof")
    with pytest.raises(ValueError):
        assignments.run_one(vectors, "B0_KMEANS", 2, 2, gray="none")
    with pytest.raises(ValueError):
        assignments.Problem(vectors, 2, 2, objective="none")
