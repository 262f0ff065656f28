"""Every registered query: same rows as its DuckDB statement, and no nested-loop or cross join in its plan."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of
from trailmark.plans.bindings import TABLES

SF_DIR = Path("/root/testdata/sf0.001")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(SF_DIR))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got = df.toPandas()
    if name in ORACLE:
        want = duck.sql(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
