"""Block SGD against walking the same order one rating at a time."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.operators import stratified as SG

R = "user_id long, item_id long, rating double"


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def normal(group, key, k, seed):
    u = [(int(md5(group, key, f"{seed}{k}{t}")[:8], 16) + 0.5) / 4294967296 for t in "ab"]
    return math.sqrt(-2 * math.log(u[0])) * math.cos(2 * np.pi * u[1])


def brute(rows, rule, blocks, group=0):
    """Epochs of one group: sub-epochs, their blocks, and in each the order of the hash."""
    mu = sum(r for *_, r in rows) / len(rows)
    b = {(s, i): 0.0 for s in (0, 1) for i in {x[s] for x in rows}}
    p = {(s, i): np.array([rule.start * normal(group, i, k, f"{rule.seed}{s}.") for k in range(rule.rank)]) for s, i in b}
    block = lambda key, name: int(md5(key, name)[:8], 16) % blocks
    order = sorted(rows, key=lambda x: (md5(x[0], x[1], rule.seed), x[0], x[1], x[2]))
    for _ in range(rule.epochs):
        for s in range(blocks):
            for u, i, r in order:
                if block(i, "ib") != (block(u, "ub") + s) % blocks:
                    continue
                x, y = p[0, u], p[1, i]
                e = (r - mu - x @ y - (b[0, u] + b[1, i] if rule.biased else 0)) * rule.precision
                if rule.biased:
                    b[0, u] += rule.lr * (e - rule.reg_user * b[0, u])
                    b[1, i] += rule.lr * (e - rule.reg_item * b[1, i])
                p[0, u], p[1, i] = x + rule.lr * (e * y - rule.reg_user * x), y + rule.lr * (e * x - rule.reg_item * y)
    return mu, b, p


def cells(users, items, seed, hot=False):
    draw = random.Random(seed)
    out = [(u, i, float(draw.randrange(1, 6))) for u in range(users) for i in range(items) if draw.random() < 0.4]
    return out + [(999, i, float(1 + i % 5)) for i in range(items)] if hot else out


@pytest.mark.parametrize(("blocks", "hot", "kind"), [(1, True, "biased"), (3, True, "biased"), (2, False, "precision"), (1, False, "free")])
def test_against_one_by_one(spark, blocks, hot, kind):
    rule = {"biased": SG.Rule(3, 3), "precision": SG.Rule(2, 2, 0.01, 0.1, 0.3, 2.0, False), "free": SG.Rule(2, 4, biased=False)}[kind]
    rows = cells(14, 11, 3, hot)
    model = SG.fit(spark.createDataFrame(rows, R).repartition(3), rule, blocks=blocks)
    mu, b, p = brute(rows, rule, blocks)
    assert abs(model.mean.first().mu - mu) < 1e-12
    users, items = model.users.collect(), model.items.collect()
    assert len(users) + len(items) == len(b)
    for r in users:
        assert abs(r.b_u - b[0, r.user_id]) < 1e-9 and np.allclose(r.p, p[0, r.user_id], atol=1e-9)
    for r in items:
        assert abs(r.b_i - b[1, r.item_id]) < 1e-9 and np.allclose(r.q, p[1, r.item_id], atol=1e-9)


def test_groups_are_apart_and_many_chunks(spark, monkeypatch):
    """Groups of different numbers of blocks at once; small chunks change the order only."""
    a, b = cells(10, 8, 1), cells(6, 5, 2)
    both = spark.createDataFrame([(*x, 1) for x in a] + [(*x, 2) for x in b] + [(1, 1, 3.0, 3)], f"{R}, g long")
    rule = SG.Rule(2, 2)
    model = SG.fit(both, rule, "g", least=2)
    for g, rows in ((1, a), (2, b)):
        _, bias, _ = brute(rows, rule, 1, g)
        own = {(0, r.user_id): r.b_u for r in model.users.where(f"grp = {g}").collect()} | {(1, r.item_id): r.b_i for r in model.items.where(f"grp = {g}").collect()}
        assert own.keys() == bias.keys() and all(abs(own[k] - bias[k]) < 1e-9 for k in own)
    assert model.mean.count() == 2
    monkeypatch.setattr(SG, "BLOCK_ROWS", 10)
    monkeypatch.setattr(SG, "CHUNK_ROWS", 3)
    strata = SG.Strata(both, SG.Rule(2, 15, 0.05, shuffled=True), "g", least=2)
    assert strata.blocks > 1 and strata.packed.groupBy("grp", "ub", "ib").count().where("count > 1").count() > 0
    assert strata.packed.select(F.max(F.size("ratings"))).first()[0] < 12
    small = strata.fit().predict(both, "g").select("rating", "pred", "g").collect()
    assert len(small) == len(a) + len(b) and np.mean([abs(r.pred - r.rating) for r in small]) < 1.1


def test_waves():
    draw = np.random.RandomState(0)
    u, i = draw.randint(0, 9, 300), draw.randint(0, 7, 300)
    order, ends = SG.waves(u, i)
    assert sorted(order.tolist()) == list(range(300)) and ends[-1] == 300
    wave = np.empty(300, int)
    for n, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends)):
        own = order[lo:hi]
        wave[own] = n
        assert len(set(u[own])) == len(own) == len(set(i[own]))
    for k in range(300):  # what shares a user or an item keeps its order
        assert all(wave[j] < wave[k] for j in range(k) if u[j] == u[k] or i[j] == i[k])


def test_models_learn_and_edges(spark):
    draw = random.Random(4)
    taste = {u: draw.choice([-1, 1]) for u in range(30)}
    rows = [(u, i, float(3 + taste[u] * (1 if i % 2 else -1) + draw.choice([0, 0, 1]))) for u in range(30) for i in range(20) if draw.random() < 0.6]
    df = spark.createDataFrame(rows, R)
    asked = df.unionAll(spark.createDataFrame([(77, 1, 3.0), (1, 88, 3.0)], R))
    from tastemill.operators.factorize import get_model

    for name, how in (("svd", {"lr": 0.05}), ("pmf", {"lr": 0.02, "sigma_sq": 0.5, "sigma_U_sq": 5.0, "sigma_V_sq": 5.0})):
        out = get_model(name)(df, asked, n_components=3, rounds=40, **how).collect()
        assert len(out) == asked.count() and all(1 <= r.pred <= 5 for r in out)
        assert np.mean([abs(r.pred - r.rating) for r in out if r.user_id < 77 and r.item_id < 88]) < 0.6
    empty = SG.fit(df.limit(0), SG.Rule(2, 2))
    assert empty.users.count() == 0 and empty.predict(asked).count() == 0
    lost = spark.createDataFrame([(1, 1, 3.0), (None, 1, 2.0), (1, None, 2.0), (1, 1, None), (1, 1, 4.0)], R)
    model = SG.fit(lost, SG.Rule(2, 1))
    assert model.users.count() == 1 and model.mean.first().mu == 3.5
