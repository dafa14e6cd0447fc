"""Quoted runs, failure scores, partial writes, and the commands of screening and comparison."""

import random

import pytest

from tastemill.operators import clusters, search
from tastemill.plans import assignments, experiment
from tastemill.sources import readers

R = "user_id long, item_id long, rating double"


def test_runs_with_quoted_fields(spark, tmp_path):
    for n, text in {"1": 'a,note,b\n1,"x, ""y""\nz",2.5\n3,,4\n', "12": "b, c\n7,word\n", "3": "a,note,b\n5,plain,1\n", "no": "a\n1\n", "4": "\n"}.items():
        (tmp_path / n).mkdir()
        (tmp_path / n / "r.csv").write_text(text)
    got = sorted(readers.read_runs(spark, str(tmp_path)).collect(), key=lambda r: (r.run_num, str(r.a)))
    assert [(r.run_num, r.a, r.note, r.b, r.c) for r in got] == [(1, 1, 'x, "y"\nz', 2.5, None), (1, 3, None, 4.0, None), (3, 5, "plain", 1.0, None), (12, None, None, 7.0, "word")]
    with pytest.raises(FileNotFoundError):
        readers.read_runs(spark, str(tmp_path / "nowhere"))


def test_scores_without_meaning(spark):
    rows = [(i, [float(i), float(i % 3)], i % 2) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, cluster_id long")
    assert set(clusters.quality(df, 2)) == set(clusters.FAILED) and clusters.quality(df, 2) != clusters.FAILED
    for label in ("0", "vec_id"):
        assert clusters.quality(df.selectExpr("vec_id", "v", f"cast({label} as long) AS cluster_id"), 2) == clusters.FAILED


def test_rows_are_saved_on_the_way(spark):
    df = clusters.cut(spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(30)], "vec_id long, v array<double>"))
    saved = []
    runs, _ = assignments.screen(df, ["B0_KMEANS", "nothing"], 2, 2, 2, 4, 1, save=lambda rows: saved.append(rows.count()), every=3)
    assert saved == [3, 1] and runs.count() == 4


def test_sources_of_searches():
    search.SOURCES["mine"] = {"X": lambda *a, **b: "ran"}
    assert search.get_optimizer("X", "mine")() == "ran"
    for name, source in (("X", "other"), ("Y", "mine")):
        with pytest.raises(ValueError):
            search.get_optimizer(name, source)
    del search.SOURCES["mine"]


def test_compare_named_searches(spark):
    draw = random.Random(2)
    df = spark.createDataFrame([(u, i, float(draw.randrange(1, 6))) for u in range(14) for i in range(9) if draw.random() < 0.6], R)
    rows = {r.algorithm: r for r in experiment.compare(spark, df, ["mk_means", "LIT_GWO", "nothing"], 2, 1, 3, workers=2).collect()}
    assert rows["mk_means"].n == rows["LIT_GWO"].n > 0 and rows["mk_means"].error is None and "nothing" in rows["nothing"].error


def test_screen_command(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setenv("TASTEMILL_EPOCHS", "1")
    monkeypatch.setenv("TASTEMILL_FACTORS", "2")
    text = experiment.command(spark, ["screen", "--data", sf, "--store", str(tmp_path / "s"), "--algorithms", "B0_KMEANS", "LIT_GWO", "--k", "2", "--repeats", "1", "--size", "3", "--workers", "2"])
    assert "LIT_GWO" in text and "B0_KMEANS" in text
