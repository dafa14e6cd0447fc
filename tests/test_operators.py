import numpy as np
import pytest

from tastemill.functions import scalars
from tastemill.operators import clusters, evaluate, kernels, predict, prepare, search, splits
from tastemill.operators.factorize import shared_items, wnmf
from tastemill.sources import readers, store
from tastemill.streaming import ratings_feed

R = "user_id long, item_id long, rating double"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_toy_factorization(spark):
    """Six observed cells of a 3 x 4 matrix: the error falls with the rounds."""
    cells = spark.createDataFrame([(0, 0, 5.0), (0, 2, 4.0), (1, 1, 3.0), (1, 3, 2.0), (2, 0, 4.0), (2, 3, 3.0)], R)

    def error(rounds):
        users, items = wnmf(cells, rank=2, rounds=rounds, every=50)
        return sum((r.pred - r.rating) ** 2 for r in predict.factor_prediction(cells, users, items, clipped=False).collect())

    assert error(4) < error(1)


def test_degenerate_similarity(spark):
    one = spark.createDataFrame([(1, 1, 3.0), (2, 1, 4.0)], R)
    assert kernels.pearson_corated(kernels.pair_sums(one)).first().sim == 0.0
    assert kernels.pearson_distance(kernels.pair_sums(one)).first().dist == 2.0
    flat = spark.createDataFrame([(u, i, 3.0) for u in (1, 2) for i in (1, 2, 3)], R)
    assert kernels.pearson_distance(kernels.pair_sums(flat)).first().dist == 2.0


def test_single_rating_is_test(spark):
    df = spark.createDataFrame([(1, 1, 3.0)] + [(2, i, 3.0) for i in range(10)], R)
    cut = splits.user_holdout(df).groupBy("user_id").agg({"is_test": "count"}).count()
    assert cut == 2
    assert splits.user_holdout(df).where("user_id = 1").first().is_test
    assert splits.user_holdout(df).where("is_test").count() == 3


def test_prune_chain(spark):
    """Dropping a user takes an item below its minimum, which takes another user."""
    df = spark.createDataFrame([(1, 1, 1.0), (2, 1, 1.0), (2, 2, 1.0), (3, 2, 1.0), (3, 3, 1.0), (4, 3, 1.0), (4, 4, 1.0), (5, 3, 1.0), (5, 4, 1.0)], R)
    left = prepare.prune(df, 2, 2)
    assert rows(left.select("user_id", "item_id")) == [(4, 3), (4, 4), (5, 3), (5, 4)]
    assert prepare.prune(df, 0, 0).count() == df.count()


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_prune_rounds(spark, most, monkeypatch):
    """Fixed rounds and the fixpoint as row by row, rows without ids too, with lists of ids broadcast or shuffled; nothing but counts is shuffled for short lists."""
    monkeypatch.setattr(prepare, "PRUNED_IDS", most)
    draw = np.random.RandomState(3)
    user, item = (draw.zipf(1.4, 4_000) % 400).tolist(), draw.randint(0, 500, 4_000).tolist()
    cells = [(None if n % 97 == 5 else u, None if n % 89 == 7 else i, float(n)) for n, (u, i) in enumerate(zip(user, item, strict=True))]
    df = spark.createDataFrame(cells, R)

    def step(left, min_user, min_item):
        for at, least in ((0, min_user), (1, min_item)):
            if least:
                of = [c[at] for c in left]
                enough = {x for x in set(of) if x is not None and of.count(x) >= least}
                left = [c for c in left if c[at] in enough]
        return left

    for min_user, min_item in ((9, 6), (0, 8), (9, 0))[: 3 if most else 1]:
        kept = [cells]
        while len(kept) < 3 or kept[-1] != kept[-2]:
            kept.append(step(kept[-1], min_user, min_item))
        sized = lambda frame: sorted(r.rating for r in frame.collect())
        assert sized(prepare.prune_once(df, min_user, min_item)) == sorted(c[2] for c in kept[1])
        assert sized(prepare.prune(df, min_user, min_item, 2)) == sorted(c[2] for c in kept[2])
        assert sized(prepare.prune(df, min_user, min_item)) == sorted(c[2] for c in kept[-1])
    plan = prepare.prune_once(df, 9, 6)._jdf.queryExecution().executedPlan().toString()
    assert ("hashpartitioning" in plan) == (most == 0)


def test_fallback_and_ties(spark):
    train = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (2, 1, 5.0)], R)
    target = spark.createDataFrame([(1, 9, 3.0)], R)
    sims = kernels.pearson_global_mean(train)
    assert predict.knn_centred(train, target, sims).first().pred == 3.0
    tied = spark.createDataFrame([(1, 7, 4.0), (1, 3, 4.0), (1, 5, 5.0)], "user_id long, item_id long, pred double")
    assert [r.item_id for r in predict.top_n(tied, 2).orderBy("rank").collect()] == [5, 3]


def test_empty_cluster_and_coincident_centres(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0], 0), (2, [1.0, 0.0], 0)], "vec_id long, v array<double>, cluster_id long")
    centres = spark.createDataFrame([(0, [0.0, 0.0]), (1, [9.0, 9.0])], "cluster_id long, c array<double>")
    got = clusters.penalized(v, centres).first()
    assert (got.fitness, got.empty) == (1001.0, 1)
    twice = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 0.0])], "cluster_id long, c array<double>")
    w = {(r.vec_id, r.cid): r.w for r in clusters.memberships(v, twice).collect()}
    assert w[1, 0] == w[1, 1] == 0.5
    assert clusters.nearest(v, twice).where("nearest <> 0").isEmpty()


def test_composite_without_range(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "algorithm string, wcss double")
    assert {r.score for r in evaluate.composite_rank(df, {"wcss": 1.0}).collect()} == {0.5}


def test_dense_ids_with_many_parts(spark):
    df = spark.range(0, 3000, 3).select("id")
    got = rows(prepare.id_map(df.withColumnRenamed("id", "item_id"), "item_id"))
    assert got == [(3 * i, i) for i in range(1000)]


def test_readers(spark, tmp_path):
    f = tmp_path / "r.dat"
    f.write_bytes("1::2::3::99\n\n4\t5\t2.5\nbad line\n6::7\ncaf\xe9::1::2\n".encode("latin-1"))
    assert rows(readers.read_ratings(spark, str(f))) == [(0, 1, 3.0, 99), (3, 4, 2.5, None)]
    m = tmp_path / "m.dat"
    m.write_text("1::A (1990)::Action|Nope|Western\n99::B::Drama\n")
    got = readers.read_movies_1m(spark, str(m), 10).first()
    assert got.item_id == 0 and sum(got.genres) == 2 and got.genres[0] == got.genres[-1] == 1
    u = tmp_path / "u.user"
    u.write_text("1|24|M|technician|85711\n2|50|F|nobody|1\n")
    a, b = readers.read_users_100k(spark, str(u)).orderBy("user_id").collect()
    assert a.male == 1 and a.occupation[19] == 1 and b.occupation[0] == 1
    with pytest.raises(ValueError):
        readers.get_loader("nope")


def test_runs_and_config(spark, tmp_path):
    for n, text in ((2, "a,b\n1,2\n"), (10, "a\n3\n")):
        (tmp_path / str(n)).mkdir()
        (tmp_path / str(n) / "x.csv").write_text(text)
    assert rows(readers.read_runs(spark, str(tmp_path))) == [(1, 2, 2), (3, None, 10)]
    assert readers.next_run_number(str(tmp_path)) == 11
    got = readers.load_config(None, ["pca.n=7", "pca.on=no"], {"pca": {"n": 5, "on": True}})
    assert got == {"pca": {"n": 7, "on": False}}


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    assert not s.has_rows("runs")
    a, b = s.start_run("x", "d", 5), s.start_run("y", "d", 5)
    s.finish_run(a)
    assert rows(s.runs().select("id", "status")) == [(1, "done"), (2, "running")]
    assert (a, b) == (1, 2)


def test_names():
    assert scalars.decode_unit([0.5, 2.0], {"n_components": (1, 10), "lr": (0.0, 1.0)}) == {"lr": 0.5, "n_components": 10}
    assert scalars.pair_epochs([1], [2, 3]) == [(1, 2), (1, 3)]
    with pytest.raises(ValueError):
        scalars.pair_epochs([1, 2], [1, 2, 3])


@pytest.mark.parametrize("name", ["PSO", "GWO", "DOA", "DE", "HHO", "DE-HHO", "GWO-PSO", "GWO+PSO", "HHO||DE"])
def test_optimizers(name):
    f = lambda p: ((p - 0.3) ** 2).sum(1)
    r = search.get_optimizer(name)(f, -np.ones(4), np.ones(4), 20, 40)
    assert r.fitness < 0.35 and r.fitness <= r.history[0]
    assert search.get_optimizer(name)(f, -np.ones(4), np.ones(4), 20, 40).fitness == r.fitness


def test_memetic_and_screening():
    f = lambda p: (p**2).sum(1)
    assert search.memetic(search.pso, f, -np.ones(3), np.ones(3), 10, 30).fitness < 0.05
    out = search.screen(["PSO", "NOPE"], f, -np.ones(3), np.ones(3), runs=1)
    assert [r["success"] for r in out] == [True, False]


def test_spark_objective(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 0.0], 0) for i in range(30)], "vec_id long, v array<double>, cluster_id long")
    score = search.clustering_objective(v, 3, 2)
    good, lost = np.array([0, 0, 1, 0, 2, 0.0]), np.array([0, 0, 1, 0, 50, 0.0])
    assert np.allclose(score(np.array([good, lost])), [0.0, 10.0 + 1000.0])


def test_shared_items(spark):
    rng = np.random.RandomState(0)
    q = rng.normal(0, 1, (12, 2))
    train = [(u, i, float(3 + q[i] @ [0.4, -0.2]), 0) for u in range(6) for i in range(12)]
    t = spark.createDataFrame(train, R + ", cluster_id long")
    items = spark.createDataFrame([(i, q[i].tolist()) for i in range(12)], "item_id long, q array<double>")
    got = shared_items(t, t, items, 2, ridge=1e-6).collect()
    assert max(abs(r.pred - min(5, max(1, r.rating))) for r in got) < 1e-3


def test_stream(spark, sf, tmp_path):
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").write.mode("overwrite").parquet(str(tmp_path / "in"))
    feed = ratings_feed.read_feed(spark, str(tmp_path / "in"))
    q = ratings_feed.user_sums(feed).writeStream.format("memory").queryName("sums").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("sums").agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
    w = ratings_feed.append_to(ratings_feed.item_windows(feed), str(tmp_path / "out"), str(tmp_path / "cp"))
    w.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
