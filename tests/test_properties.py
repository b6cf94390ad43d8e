"""Properties: results do not depend on partitioning or input order."""

import datetime as dt

import numpy as np

from conftest import SALES_DDL, sales_rows
from demandlake.operators import eda
from demandlake.operators import features as fe
from demandlake.operators import quality as qa
from demandlake.plans import forecast as fc


def _rows(df, order):
    """Rows in a fixed order; doubles to 9 significant digits (partial sums
    combine in a partition-dependent order)."""
    def norm(v):
        return float(f"{v:.9g}") if isinstance(v, float) else v
    return [tuple(norm(v) for v in r) for r in df.orderBy(*order).collect()]


def _fixture(spark):
    rng = np.random.default_rng(3)
    rows = []
    for biz, item in [("Restaurant", "Jollof Rice"), ("Cafe", "Latte"), ("Bakery", "Banana Bread")]:
        rows += sales_rows(45, business=biz, item=item, demand=[int(x) for x in rng.integers(0, 90, 45)])
    return rows


def test_features_invariant_to_partitions_and_order(spark):
    rows = _fixture(spark)
    a = spark.createDataFrame(rows, SALES_DDL)
    b = spark.createDataFrame(list(reversed(rows)), SALES_DDL).repartition(7)
    half = len(rows) // 2
    c = spark.createDataFrame(rows[half:], SALES_DDL).unionByName(spark.createDataFrame(rows[:half], SALES_DDL))
    order = ["business_type", "item_name", "date"]
    base = _rows(fe.build_features(a), order)
    assert base == _rows(fe.build_features(b), order) == _rows(fe.build_features(c), order)


def test_aggregates_invariant_to_partitions(spark):
    rows = _fixture(spark)
    a = spark.createDataFrame(rows, SALES_DDL)
    b = spark.createDataFrame(list(reversed(rows)), SALES_DDL).repartition(5)
    for op, order in [(eda.weather_impact, ["business_type", "weather_condition"]),
                      (eda.describe, ["column"]),
                      (lambda d: eda.histogram(d, "customer_demand"), ["business_type", "bin"]),
                      (qa.quality_checks, ["rule"])]:
        assert _rows(op(a), order) == _rows(op(b), order)


def test_history_tails_invariant_to_partitions(spark):
    rows = _fixture(spark) + sales_rows(3, business="Cafe", item="Espresso", start=dt.date(2025, 7, 14))
    a = spark.createDataFrame(rows, SALES_DDL)
    b = spark.createDataFrame(list(reversed(rows)), SALES_DDL).repartition(6)
    assert _rows(fc.series_tails(a), ["business_type", "item_name"]) == _rows(fc.series_tails(b), ["business_type", "item_name"])
    assert _rows(fc.business_tails(a), ["business_type"]) == _rows(fc.business_tails(b), ["business_type"])
