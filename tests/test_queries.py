"""Every registered query of the table store against DuckDB."""

import os

import pytest
from granary.plans import registry

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in registry.TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, oracle, name):
    got = registry.QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    want = oracle.execute(f"select {', '.join(f'"{n}"' for n in names)} from ({registry.ORACLES[name]})").fetchall()
    rows = [tuple(r) for r in got.select(*names).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_flagship_pushes_its_filter_and_columns_down(spark):
    plan = registry.flagship(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan and "o_orderpriority" not in plan


def test_cascades_are_joins(spark):
    plan = registry.fk_orphans(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "Cartesian" not in plan and "Python" not in plan
