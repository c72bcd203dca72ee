"""Every query with SQL gives the same rows, columns and types as DuckDB."""

import __spark_entry__ as repo
import oracle
import pytest

SQL = repo.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    assert oracle.differences(repo.queries()[name](spark, sf), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(repo.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert repo.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert repo.entry(spark).count() == 397
