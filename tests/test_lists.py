"""Lists that score only what can differ from the fallback, against scoring every unseen item; heavy items in blocks."""

import random

import pytest
from pyspark.sql import functions as F

from tastemill.operators import kernels, neighbours
from tastemill.operators.predict import item_fallback_plain

R = "user_id long, item_id long, rating double"


@pytest.fixture(scope="module")
def world(spark):
    draw = random.Random(3)
    rows = [(u, i, float(draw.randrange(1, 6))) for u in range(25) for i in range(0, 60, 2) if draw.random() < (0.9 if u == 3 else 0.15)]
    train = spark.createDataFrame(rows, R).cache()
    assignment = spark.createDataFrame([(u, u % 4, u % 5 == 0) for u in range(22)], "user_id long, cluster_id long, is_gray boolean").cache()  # 22.. have no cluster
    users = spark.createDataFrame([(u,) for u in [*range(25), 99, 3]], "user_id long")  # 99 has no rating, 3 comes twice
    items = spark.createDataFrame([(i,) for i in [*range(1, 70), 5]], "item_id long")  # some that nobody rated; item 0 is not asked for
    return train, assignment, users, items


def same(a, b):
    key = lambda df: sorted((r.user_id, r.rank, r.item_id, round(r.pred, 6)) for r in df.collect())
    assert key(a) == key(b)


@pytest.mark.parametrize(("members", "n", "clipped"), [("all", 4, True), ("white", 30, False)])
def test_knn_lists(world, members, n, clipped):
    train, assignment, users, items = world
    p = neighbours.Knn(train, assignment, k=5, members=members, clipped=clipped)
    wanted = neighbours.recommend(train, users, items, lambda t: p(t), n)
    got = neighbours.recommend(train, users, items, p, n)
    same(got, wanted)
    assert got.select("user_id").distinct().count() == 26


@pytest.mark.parametrize("clipped", [True, False])
def test_item_mean_lists(world, clipped):
    train, _, users, items = world
    p = neighbours.ItemMeans(train, clipped)
    for n in (3, 80):
        same(p.lists(users, items, n), neighbours.recommend(train, users, items, lambda t: item_fallback_plain(train, t, clipped), n))
    same(p.lists(users, items.where("item_id = 2"), 3), neighbours.recommend(train, users, items.where("item_id = 2"), lambda t: p(t), 3))


@pytest.mark.parametrize("gray", ["same", "fallback"])
def test_routed_lists(world, gray):
    train, assignment, users, items = world
    p = neighbours.Routed(train, assignment, gray, k=5)
    known = users.join(assignment, "user_id", "left_semi")
    same(p.lists(users, items, 6), neighbours.recommend(train, known, items, lambda t: p(t), 6))


def test_no_grid_in_the_plan(world):
    train, assignment, users, items = world
    plan = neighbours.Knn(train, assignment).lists(users, items, 5)._jdf.queryExecution().toString()
    assert "array_except" not in plan and "CartesianProduct" not in plan and "Cross" not in plan


@pytest.mark.parametrize("many", [kernels.MANY, 0])
def test_heavy_items_in_blocks(spark, monkeypatch, many):
    """One item that all have rated, in blocks of 4: the same similarities and predictions."""
    draw = random.Random(8)
    rows = [(u, i, float(draw.randrange(1, 6))) for u in range(30) for i in range(8) if i == 0 or draw.random() < 0.3]
    df = spark.createDataFrame(rows, R).cache()
    assignment = df.select("user_id").distinct().withColumns({"cluster_id": F.lit(1).cast("long"), "is_gray": F.lit(False)})
    asked = spark.createDataFrame([(u, i, 3.0) for u in range(30) for i in range(8)], R)
    plain = lambda x, *c: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in x.select(*c).collect())
    sums, preds = plain(kernels.pair_sums(df), "u", "v", "n", "sxy"), plain(neighbours.knn(df, asked, assignment, k=4), "user_id", "item_id", "pred")
    monkeypatch.setattr(kernels, "BLOCK", 4)
    monkeypatch.setattr(neighbours, "BLOCK", 4)
    monkeypatch.setattr(kernels, "MANY", many)
    monkeypatch.setattr(kernels, "SMALL_ROWS", 0)
    monkeypatch.setattr(kernels, "PAIRS", 50)
    heavy = kernels.heavy_keys(df, ["item_id"], 4)
    assert heavy.where("item_id = 0").first()["_parts"] == 8
    assert plain(kernels.pair_sums(df), "u", "v", "n", "sxy") == sums
    assert plain(neighbours.knn(df, asked, assignment, k=4), "user_id", "item_id", "pred") == preds
    left, right, keys = neighbours.in_blocks(df, asked, ["item_id"], "user_id", 4)
    assert left.groupBy(*keys).count().agg(F.max("count")).first()[0] <= 12 and keys == ["item_id", "_i"]
