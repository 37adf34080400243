"""Every registered query: its SQL twin, a sound plan, and the driver contract."""

import pytest

import __spark_entry__ as entry
from gate import core
from gate.check import compare, connection

ALL = entry.queries(), entry.oracle_sql()  # registers them
QUERIES, ORACLES = core.QUERIES, core.ORACLES
WITHOUT_SQL: set[str] = set()


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


def test_only_named_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(QUERIES) <= set(ALL[0]) and set(ALL[1]) <= set(ALL[0])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    assert compare(df, con, ORACLES[name]).startswith("ok")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_plan_has_no_cross_join(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["l_returnflag", "n", "mean"] and df.count() == 4
