"""Pairs of users by blocks of their vectors: the results of the joins, and no pair in a shuffle."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tastemill.operators import blocks, clusters, kernels, neighbours, predict, ratings_clusters

R = "user_id long, item_id long, rating double"


@pytest.fixture(scope="module")
def dense(spark):
    draw = random.Random(5)
    return spark.createDataFrame([(u * 3, i, float(draw.randrange(1, 6))) for u in range(60) for i in range(12) if draw.random() < 0.6], R).cache()


@pytest.fixture(scope="module")
def labels(dense):
    return dense.select("user_id").distinct().withColumns({"cluster_id": F.col("user_id") % 2, "is_gray": F.col("user_id") % 7 == 0})


def rows(df, *names):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect())


def plan(df):
    df.count()
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("users", [blocks.USERS, 7])
def test_sums_equal_the_join(spark, dense, labels, monkeypatch, users):
    monkeypatch.setattr(blocks, "USERS", users)
    for within in (None, labels):
        got = kernels.pair_sums(dense, within)
        df, keys = (dense, ["item_id"]) if within is None else (dense.join(labels, "user_id"), ["item_id", "cluster_id"])
        assert rows(got, *got.columns) == rows(kernels.joined_sums(df, keys, None, 0, 0, "rating"), *got.columns)
        assert "hashpartitioning(u#" not in plan(got) and "MapInArrow" in plan(got)


def test_few_common_items_and_odd_values_are_joined(spark, dense):
    thin = spark.createDataFrame([(u, u // 2, 1.0) for u in range(40)], R)
    assert "MapInArrow" not in plan(kernels.pair_sums(thin)) and kernels.pair_sums(thin).count() == 20
    odd = dense.unionByName(spark.createDataFrame([(1, 0, float("nan"))], R))
    clean = kernels.pair_sums(odd).where("u <> 1 AND v <> 1")
    assert "MapInArrow" not in plan(clean) and rows(clean, "u", "v", "sxy") == rows(kernels.pair_sums(dense), "u", "v", "sxy")


def test_own_norm_needs_no_join_of_pairs(dense):
    assert "hashpartitioning(u#" not in plan(kernels.pearson_own_norm(dense))


@pytest.mark.parametrize("kernel", ["pearson", "pearson_zero"])
@pytest.mark.parametrize("members", ["all", "white"])
def test_neighbours_equal_the_join(dense, labels, monkeypatch, kernel, members):
    monkeypatch.setattr(blocks, "TARGETS", 40)
    targets = dense.select("user_id").distinct().crossJoin(dense.select("item_id").distinct()).join(dense, ["user_id", "item_id"], "left_anti")
    got = neighbours.moved_in_blocks(dense, targets, labels, kernel, 4, members)
    assert rows(got, "user_id", "item_id", "up", "down") == rows(neighbours.moved_by_target(dense, targets, labels, kernel, 4, members), "user_id", "item_id", "up", "down")
    assert not any(x in plan(got) for x in ("hashpartitioning(v#", "hashpartitioning(u#"))


@pytest.mark.parametrize("kernel", ["global_mean", "cosine"])
@pytest.mark.parametrize("positive", [False, True])
def test_cluster_predictors_equal_the_table_of_pairs(dense, labels, kernel, positive):
    test, train = dense.where("(user_id + item_id) % 5 = 0"), dense.where("(user_id + item_id) % 5 <> 0")
    sims = kernels.pearson_global_mean(train, labels) if kernel == "global_mean" else kernels.cosine_corated(kernels.pair_sums(train, labels))
    old = (predict.cluster_knn if positive else predict.knn_centred)(train, test, sims, 3)
    got = predict.within_clusters(train, test, labels, kernel, 3, positive)
    assert rows(got, "user_id", "item_id", "pred") == rows(old, "user_id", "item_id", "pred") and "MapInArrow" in plan(got)


def test_similar_users_equal_the_table_of_pairs(dense):
    old = ratings_clusters.top_pairs(kernels.pearson_corated(kernels.pair_sums(dense)), 5)
    got = neighbours.similar_users(dense, 5)
    assert rows(got, "u", "v", "sim") == rows(old, "u", "v", "sim") and "hashpartitioning(u#" not in plan(got)


def test_seeds_from_tasks_without_rows(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, v array<double>")
    assert clusters.seed_by_distance(df.repartition(20, "vec_id"), 3) == clusters.seed_by_distance(df.coalesce(1), 3)


def test_silhouette_shuffles_ratings_and_no_pairs(spark, dense, labels):
    """By hand from the similarities of all pairs."""
    users = {r.user_id: r.cluster_id for r in labels.collect()}
    alone = spark.createDataFrame([(1000, 999, 3.0), (1001, 998, 2.0)], R)
    df, every = dense.unionByName(alone), labels.select("user_id", "cluster_id").unionByName(spark.createDataFrame([(1000, 0), (1001, 1)], "user_id long, cluster_id long"))
    users |= {1000: 0, 1001: 1}
    sim = {}
    for r in kernels.pearson_corated(kernels.pair_sums(df), -1.0, clip=False).collect():
        sim[r.u, r.v] = sim[r.v, r.u] = r.sim
    total = 0.0
    for u, own in users.items():
        mean = {}
        for c in (0, 1):
            far = [1 - sim.get((u, v), -1.0) for v in users if v != u and users[v] == c]
            mean[c] = sum(far) / len(far)
        total += (mean[1 - own] - mean[own]) / max(mean.values())
    got = ratings_clusters.pearson_silhouette(df, every)
    assert abs(got.first().silhouette - total / len(users)) < 1e-6
    assert not re.search(r"hashpartitioning\((u#\w+, v#|v#\w+, u#)", plan(got))


@pytest.mark.parametrize("kernel", ["pearson", "pearson_zero"])
@pytest.mark.parametrize("step", [1.0, 0.3])
def test_pairs_that_cannot_be_among_the_best_are_left_out(dense, labels, monkeypatch, kernel, step):
    for name, x in (("FIRST", 12), ("TILE", 5), ("USERS", 16)):
        monkeypatch.setattr(blocks, name, x)
    df = dense.withColumn("rating", F.col("rating") * step)
    wide = ratings_clusters.top_pairs(kernels.pearson_corated(kernels.pair_sums(df), -1.0 if kernel == "pearson" else 0.0, clip=kernel != "pearson"), 2)
    assert rows(neighbours.similar_users(df, 2, kernel), "u", "v", "sim") == rows(wide, "u", "v", "sim")
    targets = df.select("user_id").distinct().crossJoin(df.select("item_id").distinct()).join(df, ["user_id", "item_id"], "left_anti")
    got = neighbours.moved_in_blocks(df, targets, labels, kernel, 2)
    assert rows(got, "user_id", "item_id", "up", "down") == rows(neighbours.moved_by_target(df, targets, labels, kernel, 2), "user_id", "item_id", "up", "down")


def test_few_pairs_pass_the_comparison_of_squares():
    import numpy as np

    draw = np.random.default_rng(3)
    near, far = (blocks.Side(np.arange(n), np.full(n, 30), np.tile(np.arange(30), n), draw.integers(1, 6, 30 * n).astype(float)) for n in (40, 900))
    known = np.arange(30)
    for kind in (np.float32, np.float64):
        left, right = (tuple(x.astype(kind) for x in s.dense(known)) for s in (near, far))
        sim = np.abs(blocks.similarity("pearson", tuple(x.astype(float) for x in blocks.six(left, right))))
        r, c, sums = blocks.may_beat(left, right, np.full(40, 500_000))
        assert set(zip(*np.nonzero(sim >= 0.5), strict=True)) <= set(zip(r, c, strict=True)) and len(r) <= (sim > 0.4999).sum() < sim.size / 20
        assert np.array_equal(np.abs(blocks.similarity("pearson", sums)), sim[r, c])


def test_users_of_equal_vectors_are_met_once(dense, monkeypatch):
    copies = dense.unionByName(dense.select((F.col("user_id") + 1).alias("user_id"), "item_id", "rating")).unionByName(dense.where("user_id = 0").crossJoin(dense.sparkSession.range(20)).select((F.col("id") + 1000).alias("user_id"), "item_id", "rating"))
    met, real = [], blocks.meet
    monkeypatch.setattr(blocks, "meet", lambda raters, asking, *more: met.append((raters.select("user_id").distinct().count(), asking.count())) or real(raters, asking, *more))
    got = neighbours.similar_users(copies, 5)
    wide = ratings_clusters.top_pairs(kernels.pearson_corated(kernels.pair_sums(copies)), 5)
    assert rows(got, "u", "v", "sim") == rows(wide, "u", "v", "sim")
    assert met == [(124, 60)]


def test_only_items_that_gain_a_neighbour_are_updated():
    import numpy as np

    has, dev = np.array([[1, 1, 0], [1, 0, 0], [1, 1, 1]], bool), np.arange(9.0).reshape(3, 3)
    some, keys, sims, devs = blocks.best_of_row(np.array([0, 2]), np.array([5, 7]), np.array([0.5, 0.7]), has, dev, np.arange(3), 2, np.array([7, 4, -1]))
    assert some.tolist() == [1, 2] and keys.tolist() == [[7, 5], [7, -1]]
    assert sims.tolist() == [[0.7, 0.5], [0.7, 0.0]] and devs.tolist() == [[7.0, 1.0], [8.0, 0.0]]
    assert not len(blocks.best_of_row(np.array([1]), np.array([5]), np.array([0.5]), has, dev, np.arange(3), 2, np.array([9, -1, -1]))[0])
