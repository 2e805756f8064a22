"""Every registered query with SQL against DuckDB on the smallest tables, all rows."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect

ORACLE = oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf001, name):
    df = queries()[name](spark, sf001)
    assert compare(connect(sf001), df, ORACLE[name]) == ""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 1
