import compare
import pytest
from spanlab.plans import further, more  # noqa: F401
from spanlab.plans import queries as Q


@pytest.fixture(scope="module")
def con(sf):
    return compare.duck(sf)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_against_duckdb(spark, sf, con, name):
    compare.same(Q.QUERIES[name](spark, sf), Q.ORACLE_SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
