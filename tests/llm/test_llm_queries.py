"""Every query of the subpackage runs; those with SQL give the same rows."""

from __future__ import annotations

import pytest

from terrasieve.llm import catalog
from tests.comparing import DATA, connection, same_rows

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, con, name):
    same_rows(QUERIES[name](spark, DATA), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() > 0
