"""Every registered query: the shape of its plan, and its rows against its oracle SQL."""

import re

import pytest

import __spark_entry__ as entry
from catalog import QUERIES
from tests.oracle import connect, differences

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    plans = []

    def run(spark, d):
        df = entry.queries()[name](spark, d)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    problem, rows = differences(spark, con, name, run, entry.oracle_sql().get(name), SMALL)
    assert problem is None and rows > 0
    # no pairing of all rows, no row-at-a-time Python, no window over a whole table in one task
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", plans[0])
    assert not re.search(r"Window \[[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", plans[0])


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["host", "unseen"]
