"""Every query against its statement in DuckDB, and the driver's contract."""

import pytest
from oracle import connection, difference

import __spark_entry__ as entry
from sagaframe.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_statement(spark, con, name):
    assert difference(con, catalog.ORACLES[name], catalog.QUERIES[name](spark, SF)) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_statement(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["c_custkey", "n_orders", "rank", "total", "tied"]


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_cartesian_products(spark):
    for name in ("overlap_pairs", "band_join_minutes", "interval_clip", "event_to_span", "containment_pairs"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["rank_filtered_anchor"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan
    plan = catalog.QUERIES["peer_count"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "c_acctbal" not in plan
