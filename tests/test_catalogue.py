import pytest
from oracle import connect, same

from tastemill.plans import catalogue


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_twin(spark, sf, con, name):
    same(catalogue.QUERIES[name](spark, sf), con, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_whole_tables(spark, sf, con):
    """The queries without bounds on ids take every user and item."""
    users, items = con.sql("SELECT count(DISTINCT user_id), count(DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT)) FROM events").fetchall()[0]
    wide = catalogue.QUERIES["pivot_matrix_whole"](spark, sf)
    assert (wide.count(), len(wide.columns)) == (users, items + 1)
    mean = {(r.user_id, r.item_id): r.rating for r in catalogue.QUERIES["ratings_mean"](spark, sf).collect()}
    for r in wide.collect():
        assert all(abs(r[c] - mean.get((r.user_id, int(c)), 0.0)) < 1e-5 for c in wide.columns if c != "user_id")
    train, test, _ = catalogue.split(spark, sf)
    assert catalogue.QUERIES["remap_users_whole"](spark, sf).count() == test.join(train.select("user_id").distinct(), "user_id").count()
    assert catalogue.QUERIES["union_correlation_whole"](spark, sf).count() == users * catalogue.N_CLUSTERS


def test_entry_imports():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
