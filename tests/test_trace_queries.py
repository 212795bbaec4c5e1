import pytest

from tests.compare import rows_of, rows_of_sql
from tracelake.operators import lookups
from tracelake.plans import edge_queries, source_queries, trace_queries
from tracelake.sources import testdata


@pytest.mark.parametrize("key", sorted(trace_queries.QUERIES))
def test_query_agrees_with_sql(key, spark, sf_dir, duck):
    assert rows_of(trace_queries.QUERIES[key](spark, sf_dir)) == rows_of_sql(duck, trace_queries.ORACLE[key])


@pytest.mark.parametrize("key", sorted(source_queries.QUERIES))
def test_what_is_written_comes_back(key, spark, sf_dir, duck):
    assert rows_of(source_queries.QUERIES[key](spark, sf_dir)) == rows_of_sql(duck, source_queries.ORACLE[key])


@pytest.mark.parametrize("key", sorted(edge_queries.QUERIES))
def test_ties_and_straddles(key, spark, sf_dir, duck):
    got = rows_of(edge_queries.QUERIES[key](spark, sf_dir))
    assert got[1] and got == rows_of_sql(duck, edge_queries.ORACLE[key])


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(trace_queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_range_filters_reach_the_scan(spark, sf_dir):
    plan = lookups.instructions_range(testdata.view(spark, sf_dir, "instructions"), 100, 7_000)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_orderkey" in plan and "LessThanOrEqual(l_orderkey" in plan
    assert "l_extendedprice" not in plan
