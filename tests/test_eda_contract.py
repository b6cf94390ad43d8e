"""EDA aggregates against pandas/numpy, and contract table jobs."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import SALES_DDL, sales_rows
from demandlake.operators import contract as ct
from demandlake.operators import eda
from demandlake.operators import quality as qa


def _df(spark):
    rng = np.random.default_rng(5)
    rows = sales_rows(40, demand=[int(x) for x in rng.integers(0, 60, 40)])
    rows += sales_rows(25, business="Cafe", item="Latte", demand=[7] * 25)  # constant demand
    return spark.createDataFrame(rows, SALES_DDL)


def test_describe_matches_pandas(spark):
    df = _df(spark)
    pdf = df.toPandas()
    got = {r.column: r for r in eda.describe(df).collect()}
    for c in eda.DESCRIBE_COLS:
        d = pdf[c].astype(float).describe()
        r = got[c]
        np.testing.assert_allclose([r["count"], r["mean"], r["std"], r["min"], r.p25, r.p50, r.p75, r["max"]],
                                   [d["count"], d["mean"], d["std"], d["min"], d["25%"], d["50%"], d["75%"], d["max"]],
                                   rtol=1e-12, atol=1e-12)


def test_histogram_matches_numpy(spark):
    df = _df(spark)
    pdf = df.toPandas()
    got = eda.histogram(df, "customer_demand").toPandas()
    for biz, g in pdf.groupby("business_type"):
        counts, edges = np.histogram(g["customer_demand"].astype(float), bins=30)
        mine = got[got.business_type == biz].sort_values("bin")
        assert list(mine.n) == list(counts)
        np.testing.assert_allclose(mine.lower, edges[:-1], atol=1e-9)
        np.testing.assert_allclose(mine.upper, edges[1:], atol=1e-9)


def test_correlation_pairwise_and_constant(spark):
    df = _df(spark).where("business_type = 'Cafe'")  # demand constant here
    got = {(r.col_a, r.col_b): r.r for r in eda.correlation(df).collect()}
    assert got[("customer_demand", "customer_demand")] is None
    assert got[("customer_demand", "quantity_available")] is None
    full = _df(spark)
    pdf = full.toPandas()[eda.CORR_COLS].astype(float)
    exp = pdf.corr()
    got = {(r.col_a, r.col_b): r.r for r in eda.correlation(full).collect()}
    for a in eda.CORR_COLS:
        for b in eda.CORR_COLS:
            e = exp.loc[a, b]
            if np.isnan(e):
                assert got[(a, b)] is None
            else:
                assert abs(got[(a, b)] - e) < 1e-9


def test_missing_dates_and_null_counts(spark):
    rows = sales_rows(3) + [("Restaurant", "Jollof Rice", dt.date(2025, 6, 6), 50.0, 4.0, 1, 1, 1, 0, None, 0)]
    df = spark.createDataFrame(rows, SALES_DDL)
    gaps = sorted(r.date for r in eda.missing_dates(df).collect())
    assert gaps == [dt.date(2025, 6, 4), dt.date(2025, 6, 5)]
    nulls = {r.column: r.n_null for r in eda.null_counts(df).collect()}
    assert nulls["weather_condition"] == 1 and nulls["price"] == 0


def test_business_insights_and_waste_pct(spark):
    df = spark.createDataFrame(sales_rows(4), SALES_DDL)
    r = eda.business_insights(df).first()
    pdf = df.toPandas()
    assert r.units_sold == pdf.quantity_sold.sum() and r.n_days == 4
    assert abs(r.revenue - (pdf.quantity_sold * pdf.price).sum()) < 1e-9
    w = eda.waste_pct_by_item(df).first()
    assert w.mean_waste_pct == round(float((pdf.waste_quantity / pdf.quantity_available * 100).mean()), 2)


def test_upsert_newest_wins_and_duplicates(spark):
    old = spark.createDataFrame([("Cafe", "Latte", "2025-06-01", 10, 1), ("Cafe", "Latte", "2025-06-02", 11, 1)],
                                "business_type string, item_name string, d string, v bigint, version int")
    new = spark.createDataFrame([("Cafe", "Latte", "2025-06-02", 99, 2), ("Cafe", "Latte", "2025-06-02", 98, 2),
                                 ("Cafe", "Latte", "2025-06-03", 12, 2)],
                                "business_type string, item_name string, d string, v bigint, version int")
    out = {r.d: r.v for r in ct.upsert(old, new, ["business_type", "item_name", "d"], "version").collect()}
    assert out["2025-06-01"] == 10 and out["2025-06-03"] == 12
    assert out["2025-06-02"] == 99  # one row per key, from the newest version; equal versions: the largest row
    assert ct.upsert(old, new, ["business_type", "item_name", "d"], "version").count() == 3


def test_todays_forecasts_and_default_weather(spark):
    fc = spark.createDataFrame([("Cafe", "Latte", dt.date(2025, 6, 1), 10), ("Cafe", "Bun", dt.date(2025, 6, 1), 5),
                                ("Bakery", "Bun", dt.date(2025, 6, 1), 7), ("Cafe", "Latte", dt.date(2025, 6, 2), 3)],
                               "business_type string, item_name string, forecast_date date, predicted_demand bigint")
    items = spark.createDataFrame([("Cafe", "Latte", 1), ("Cafe", "Bun", 2), ("Bakery", "Bun", 3)],
                                  "business_type string, item_name string, item_id int")
    rows = ct.todays_forecasts(fc, items, "Cafe", "2025-06-01").collect()
    assert [(r.item_name, r.item_id, r.predicted_demand) for r in rows] == [("Bun", 2, 5), ("Latte", 1, 10)]
    req = spark.createDataFrame([(1, None), (2, ["Rainy"] * 7)], "request_id int, weather_forecast array<string>")
    got = {r.request_id: r.weather_forecast for r in ct.default_weather(req).collect()}
    assert got == {1: ["Clear"] * 7, 2: ["Rainy"] * 7}


def test_week_arrays_must_have_seven_days(spark):
    base = ("Latte", "Cafe", 5.0, 1.0, "2025-12-01")
    df = spark.createDataFrame([(1, *base, ["Clear"] * 6, [0] * 7), (2, *base, ["Clear"] * 8, [0] * 8),
                                (3, *base, ["Clear"] * 7, [0] * 7)],
                               "request_id int, item_name string, business_type string, price double, "
                               "shelf_life_hours double, starting_date string, weather_forecast array<string>, "
                               "holiday_flags array<int>")
    ok, bad = qa.validate_requests(df)
    reasons = {r.request_id: r.reasons for r in bad.collect()}
    assert reasons == {1: ["weather_not_7"], 2: ["weather_not_7", "holidays_not_7"]}
    assert [r.request_id for r in ok.collect()] == [3]
    assert ok.where(F.col("item_name") == "Latte").count() == 1
