"""Plan checks: no Cartesian products and no Python in any exact key's plan;
filters and projections reach the Parquet scan."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


# The walk of a tree model is a vectorised Python function.
WALKS_TREES = {"ranker_score_fixed"}


@pytest.mark.parametrize("key", sorted(set(E.oracle_sql()) - set(E.LLM_QUERIES) - WALKS_TREES))
def test_no_product_no_python(spark, key):
    df = E.queries()[key](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for op in FORBIDDEN:
        assert op not in plan, f"{key}: {op}"


def test_scan_pruning(spark):
    from marquee.sources.adapter import driver_tables
    t = driver_tables(spark, SF)
    df = t.hybrid.filter("movieId = 3").select("movieId", "genres")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(movieId), EqualTo(movieId,3)]" in plan
    assert "ReadSchema: struct<movieId:int,genres:string>" in plan
