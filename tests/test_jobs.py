"""Runs that are stopped, runs side by side, and a store that several writers share."""

import random
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tastemill.operators import clusters
from tastemill.plans import assignments, experiment, jobs
from tastemill.sources.store import Store

R = "user_id long, item_id long, rating double"


def cells(n=14, d=9, seed=1):
    draw = random.Random(seed)
    return [(u, i, float(draw.randrange(1, 6))) for u in range(n) for i in range(d) if draw.random() < 0.6]


def slow(spark, seconds, n=2):
    def rest(batches):
        for b in batches:
            time.sleep(seconds)
            yield pd.DataFrame({"id": b.id})

    return spark.range(0, n, 1, n).mapInPandas(rest, "id long").count()


def test_a_run_is_stopped_near_its_limit(spark):
    began = time.time()
    with pytest.raises(TimeoutError):
        jobs.limited(spark, lambda: slow(spark, 60), 2.0)
    assert 2.0 <= time.time() - began < 20
    began = time.time()
    with pytest.raises(TimeoutError):  # many short jobs: stopped between or in them
        jobs.limited(spark, lambda: [slow(spark, 0.05) for _ in range(1000)], 2.0)
    assert time.time() - began < 20
    assert jobs.limited(spark, lambda: slow(spark, 0.01), 60.0) == 2 == jobs.limited(spark, lambda: slow(spark, 0), None)
    with pytest.raises(ZeroDivisionError):
        jobs.limited(spark, lambda: 1 // 0, 60.0)
    assert spark.range(5).count() == 5  # nothing of ours cancels later jobs


def test_runs_overlap_and_keep_their_order(spark):
    tracker, most, end = spark.sparkContext.statusTracker(), [0], threading.Event()

    def look():
        while not end.is_set():
            most[0] = max(most[0], len(tracker.getActiveJobsIds()))
            time.sleep(0.05)

    watcher = threading.Thread(target=look)
    watcher.start()
    pools = []

    def work(n):
        pools.append(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
        slow(spark, 1.5, 1)
        if n == 2:
            raise KeyError("two")
        return n * 10

    found = jobs.side_by_side(spark, [lambda n=n: work(n) for n in range(5)], 3)
    end.set()
    watcher.join()
    assert [x if not isinstance(x, Exception) else "lost" for x in found] == [0, 10, "lost", 30, 40]
    assert most[0] >= 2 and set(pools) == {"run-0", "run-1", "run-2"}
    with pytest.raises(KeyError):
        jobs.all_or_raise(found)
    one = jobs.side_by_side(spark, [lambda: slow(spark, 30, 1), lambda: 7], 2, limit=1.0)
    assert isinstance(one[0], TimeoutError) and one[1] == 7
    assert jobs.side_by_side(spark, [lambda: 1], 2, start_until=time.time() - 1) == []
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_same_rows_side_by_side(spark, tmp_path):
    df = spark.createDataFrame(cells(), R)
    config = experiment.settings(overrides=["data.folds=2", "clustering.k=2", "model.rounds=1", "model.n_components=2", "clustering.rounds=1", "evaluation.at_n=[3]", "recommender.kind=cluster_average"])
    plain = lambda x: sorted((r.fold, r.metric, r.value) for r in x.collect())
    assert plain(experiment.cross_validate(spark, df, config, 2)) == plain(experiment.cross_validate(spark, df, config))
    vectors, d = assignments.features(df, {"factors": 2, "rounds": 1})
    vectors = clusters.cut(vectors)
    rows = []
    for workers in (1, 3):
        runs, history = assignments.screen(vectors, ["B0_KMEANS", "LIT_GWO"], 2, d, 1, 3, 2, workers=workers)
        rows.append((sorted((r.algorithm, r.wcss, r.davies_bouldin) for r in runs.collect()), sorted(tuple(r) for r in history.collect())))
    assert rows[0] == rows[1]
    st = Store(spark, str(tmp_path / "s"))
    done = experiment.produce_assignments(spark, st, df, "toy", ["kmeans", "GWO", "hho"], 2, {"factors": 2, "rounds": 1}, 3, 1, workers=3, members=True, gray="percentile")
    ids = sorted(r.id for r in done.collect())
    assert ids == [1, 2, 3] and all(st.labels(i).count() == 14 and st.memberships(i).count() == 28 for i in ids)
    out = experiment.run_scenarios(spark, st, df, "toy", "B0_KMEANS", 2, [assignments.suffix({"factors": 2})], [{"rank": 2, "rounds": 1, "epochs": 1}], workers=2)
    assert "cluster_avg_soft" in {r.scenario for r in out.collect()}


def test_a_screened_run_that_is_stopped_is_a_row(spark):
    vectors = clusters.cut(spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(60)], "vec_id long, v array<double>"))
    began = time.time()
    runs, history = assignments.screen(vectors, ["LIT_GWO", "B1_HHO"], 2, 2, 1, 4, 10_000, limit=3.0, workers=2)
    rows = runs.collect()
    assert time.time() - began < 40 and len(rows) == 2 and history.count() == 0
    assert all(not r.success and "TimeoutError" in r.error for r in rows)


def test_writers_never_share_an_id(spark, tmp_path):
    one, two = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    ids, lock = [], threading.Lock()

    def take(st):
        for _ in range(8):
            new = st.reserve("runs")
            with lock:
                ids.append(new)

    threads = [threading.Thread(target=take, args=(s,)) for s in (one, two, one)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(ids) == list(range(1, 25))
    assert one.start_run("x", "d", 2) == 25
    labels = spark.createDataFrame([(1, 0, False, 0.5), (2, 1, True, 1.5)], "user_id long, cluster_id long, is_gray boolean, score double")
    a, b = one.save_assignment(labels, "d", "x", 2), two.save_assignment(labels, "d", "y", 2)
    assert (a, b) == (1, 2) and one.labels(b).count() == 2 and one.memberships(a).isEmpty()
    plan = one.read("labels").where(F.col("assignment_id") == a)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(assignment_id" in plan
