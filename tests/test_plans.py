"""Physical-plan properties: no Python UDFs anywhere, filters and column
pruning reach the scan, top-n is a window group limit, partial aggregation
before the shuffle."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: these fit models (forests, boosting) while they build their plan
SKIP = {"model_compare", "feature_importance_top20", "retrain_decision", "model_ridge_eval", "forecast_week", "forecast_day",
        "daily_forecasts_generate"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data missing")
def test_no_python_udfs_in_any_plan(spark):
    bad = []
    for name, fn in entry.catalog.queries().items():
        if name in SKIP or name.startswith("stream_"):
            continue
        plan = _plan(fn(spark, SF))
        if any(k in plan for k in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas")):
            bad.append(name)
    assert not bad, bad


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data missing")
def test_scan_pushdown_pruning_and_partial_aggregation(spark):
    q = entry.queries()
    plan = _plan(q["sales_daily"](spark, SF))
    assert "PushedFilters: [In(l_returnflag, [A,N,R])" in plan
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_discount:double,l_returnflag:string" in plan
    assert "partial_sum" in plan
    plan = _plan(q["history_last_30"](spark, SF))
    assert "WindowGroupLimit" in plan
    plan = _plan(q["history_partition_read"](spark, SF))
    assert "PartitionFilters: [isnotnull(business_type" in plan
