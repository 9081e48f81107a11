"""Every query with an SQL twin, on the smallest tables; the rest must run."""

import os

import pytest

from oracle import compare, connect

FOLDER = os.environ.get("FLOWLENS_TABLES", "/root/testdata/sf0.001")


def registered():
    from flowlens.plans import ORACLES
    return sorted(ORACLES)


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
@pytest.mark.parametrize("name", registered())
def test_query_equals_sql(spark, con, name):
    from flowlens.plans import ORACLES, QUERIES
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLES[name]) == ""


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    from flowlens.plans import QUERIES
    plan = QUERIES["b17_file_filter"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_shipdate:" in plan
    plan = QUERIES["d37_timeseries"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "user_id" not in plan.split("ReadSchema")[1].split("\n")[0]
    for name in ("d35_campaigns", "d24_threshold_sweep", "c06_map_mitre", "d39_hotspots"):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
