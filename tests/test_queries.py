"""Every query with SQL gives the same rows on DuckDB; the others run."""

from __future__ import annotations

from pathlib import Path

import pytest

import oracle
from folioscope.plans import cases, changes, facts, lines, papers, problems, readings

FOLDER = "/root/testdata/sf0.001"
QUERIES = {k: f for m in (facts, lines, papers, changes, readings, cases) for k, f in m.CATALOGUE.queries.items()} | problems.QUERIES
ORACLES = {k: q for m in (facts, lines, papers, changes, readings, cases) for k, q in m.CATALOGUE.oracles.items()}

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    assert oracle.rows_of_spark(QUERIES[name](spark, FOLDER)) == oracle.rows_of_sql(con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.columns and df.count() >= 0


def test_every_query_is_described():
    assert all(line for _, line in facts.CATALOGUE.describe())


def test_names_of_entry():
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_joins_are_equi_joins(spark):
    for name in ("contract_overlap", "chained_renewals", "minutes_near_awards", "lines_in_pieces"):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
