"""Every registered query of the core runs; those with SQL give the same rows."""

from __future__ import annotations

import pytest

from terrasieve import catalog
from terrasieve.queries.quality import sound_loads
from tests.comparing import DATA, connection, same_rows

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection()


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, con, name):
    same_rows(QUERIES[name](spark, DATA), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() >= (name != "packed_segments")  # the small table holds no sequences


def test_models_leave_out_the_loads_that_have_issues(spark, con):
    name = "combined_variables_dataset"
    bad = {r[0] for r in con.sql(SQL["p6_found"]).filter(f"tbl = '{name}'").project("load_no").fetchall()}
    every = {r[0] for r in con.sql(f"select distinct load_no from {name}").fetchall()}
    kept = {r[0] for r in sound_loads(spark, DATA, name).select("load_no").distinct().collect()}
    assert kept == every - bad
    assert kept != {1, 3, 5, 8}
