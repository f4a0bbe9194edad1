"""Regression guard: every SQL-checked query equals its DuckDB oracle on sf0.001."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_all_oracle_queries_match(spark):
    import duckdb

    import __spark_entry__ as E
    from oracle_check import TABLES, digest

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    qs, sqls = E.queries(), E.oracle_sql()
    bad = []
    for name, sql in sqls.items():
        sdf = qs[name](spark, SF)
        srows = [tuple(r) for r in sdf.collect()]
        rel = con.sql(sql)
        drows = rel.fetchall()
        if sorted(sdf.columns) != sorted(rel.columns) or digest(sdf.columns, srows)[0] != digest(rel.columns, drows)[0]:
            bad.append(name)
    assert not bad, bad


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_no_cartesian_or_nested_loop_joins(spark):
    """Scale rule: no registered (SQL-checked) query plans a cross product or a
    nested-loop join, even with broadcast joins allowed."""
    import __spark_entry__ as E

    qs = E.queries()
    bad = []
    for name in E.oracle_sql():
        plan = qs[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        if "CartesianProduct" in plan or "NestedLoopJoin" in plan:
            bad.append(name)
    assert not bad, bad
