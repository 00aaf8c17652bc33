"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import __spark_entry__ as contract
import pytest
from check import compare, duck

SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def connection(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_agrees_with_sql(spark, small, connection, name):
    frame = contract.queries()[name](spark, small)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval", "BatchEval"):
        assert bad not in plan
    if name in SQL:
        assert compare(frame, connection, SQL[name]) == ""
    else:
        assert frame.count() > 0


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(contract.queries())


@pytest.mark.parametrize(
    "name", ["count_by_language", "count_by_year", "count_by_decade", "group_stats"]
)
def test_counts_add_up_to_the_rows(spark, small, name):
    rows = contract.queries()["clean_rows"](spark, small).count()
    counted = contract.queries()[name](spark, small)
    column = "row_count" if "row_count" in counted.columns else "movie_count"
    assert sum(row[column] for row in counted.collect()) == rows
