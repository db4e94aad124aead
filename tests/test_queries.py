"""Every registered query against its SQL, and the shape of every plan."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from cohortloom.plans import clinic_queries, table_queries
from tests.oracle_check import compare, connect

SMALL = "/root/testdata/sf0.001"
# The queries of the training-data folder are tested in a folder of their own.
OWN = [*table_queries.QUERIES, *clinic_queries.QUERIES]
ORACLE = {name: sql for name, sql in entry.oracle_sql().items() if name in OWN}
QUERIES = {name: entry.queries()[name] for name in OWN}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|Python|ArrowEval", plan)
    assert compare(df, duck, ORACLE[name]) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [row.step for row in rows] == [1, 2, 3, 4]
    assert all(a.n_rows >= b.n_rows and a.n_keys >= b.n_keys for a, b in zip(rows, rows[1:]))
