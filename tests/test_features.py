"""Series features (W1-W4, P1-P13) against pandas on hand fixtures."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from conftest import SALES_DDL, sales_rows
from demandlake.operators import features as fe
from demandlake.schema import FEATURE_COLS


def _pandas_windows(demand, include_current=True):
    s = pd.Series(demand, dtype="float64")
    src = s if include_current else s.shift(1)
    out = {
        "prev_day_demand": s.shift(1),
        "prev_week_demand": s.shift(7),
    }
    for n in (3, 7, 14, 30):
        out[f"rolling_{n}day_demand"] = src.rolling(n, min_periods=1).mean()
    for n in (7, 14):
        out[f"rolling_{n}day_std"] = src.rolling(n, min_periods=1).std()
    return pd.DataFrame(out)


@pytest.mark.parametrize("n", [1, 6, 7, 13, 14, 29, 30, 31])
@pytest.mark.parametrize("include_current", [True, False])
def test_windows_match_pandas(spark, n, include_current):
    rng = np.random.default_rng(n)
    demand = [int(x) for x in rng.integers(0, 80, n)]
    df = spark.createDataFrame(sales_rows(n, demand=demand), SALES_DDL)
    got = fe.add_rolling(fe.add_lags(df), include_current=include_current).orderBy("date").toPandas()
    exp = _pandas_windows(demand, include_current)
    for c in exp.columns:
        np.testing.assert_allclose(got[c].astype("float64").to_numpy(), exp[c].to_numpy(), rtol=1e-9, atol=1e-9,
                                   equal_nan=True, err_msg=c)


def test_series_are_separate_and_gaps_are_rows(spark):
    rows = sales_rows(5, business="Restaurant", item="Latte") + sales_rows(5, business="Cafe", item="Latte",
                                                                           demand=[100] * 5)
    # a date gap: rows, not days, define the lag
    rows += [("Bakery", "Donuts", dt.date(2025, 6, 1), 15.0, 12.0, 10, 9, 9, 1, "Clear", 0),
             ("Bakery", "Donuts", dt.date(2025, 6, 9), 15.0, 12.0, 10, 7, 7, 3, "Clear", 0)]
    df = spark.createDataFrame(rows, SALES_DDL)
    got = fe.add_lags(df).toPandas()
    cafe = got[got.business_type == "Cafe"].sort_values("date")
    assert cafe.prev_day_demand.iloc[1] == 100  # never reads the Restaurant series
    donuts = got[got.item_name == "Donuts"].sort_values("date")
    assert donuts.prev_day_demand.iloc[1] == 9


def test_build_features_full_contract(spark):
    rows = sales_rows(20) + [("Cafe", "Mystery Drink", dt.date(2025, 6, 1), 10.0, 1.0, 5, 5, 6, 0, None, 0)]
    df = spark.createDataFrame(rows, SALES_DDL)
    out = fe.build_features(df)
    pdf = fe.feature_frame(out).toPandas()
    assert list(pdf.columns) == FEATURE_COLS and len(FEATURE_COLS) == 34
    assert not pdf.isna().any().any()  # numeric nulls filled with 0
    r = out.where("item_name = 'Mystery Drink'").first()
    assert r.is_rainy == 0 and r.category == "beverage" and r.category_encoded == 1 and r.business_encoded == 1
    first = out.where("item_name = 'Jollof Rice'").orderBy("date").first()
    # 2025-06-01 is a Sunday
    assert (first.day_of_week, first.day_name, first.is_weekend, first.is_sunday) == (6, "Sunday", 1, 1)
    assert first.friday_x_weekend == 0 and first.rolling_7day_std == 0
    assert abs(first.day_sin - np.sin(2 * np.pi * 6 / 7)) < 1e-12


def test_iso_week_and_money(spark):
    rows = [("Restaurant", "Plantain", dt.date(2021, 1, 3), 20.0, 4.0, 0, 0, 0, 0, "Clear", 0)]
    df = spark.createDataFrame(rows, SALES_DDL)
    r = fe.add_waste_pct(fe.add_money(fe.add_calendar(df))).first()
    assert r.week_of_year == 53  # ISO week of 2021-01-03
    assert r.waste_pct == 0.0 and r.revenue == 0.0


def test_sold_waste_rule(spark):
    df = spark.createDataFrame([(10, 7), (5, 9), (0, 0)], "customer_demand bigint, quantity_available bigint")
    got = [(r.quantity_sold, r.waste_quantity) for r in fe.derive_sold_waste(df).collect()]
    assert got == [(7, 0), (5, 4), (0, 0)]


def test_enrich_items_with_dimension_table(spark):
    df = spark.createDataFrame(sales_rows(2, item="House Special") + sales_rows(2, item="Green Tea"), SALES_DDL)
    dim = spark.createDataFrame([("House Special", "main_meal", 5)],
                                "item_name string, category string, preparation_complexity int")
    got = {r.item_name: (r.category, r.preparation_complexity) for r in fe.enrich_items(df, dim=dim).collect()}
    assert got == {"House Special": ("main_meal", 5), "Green Tea": ("beverage", 1)}
    plan = fe.enrich_items(df, dim=dim)._jdf.queryExecution().logical().toString()
    assert "hint" not in plan.lower()  # the planner decides by size


def test_densified_lags_count_days(spark):
    rows = [("Cafe", "Latte", dt.date(2025, 6, 1) + dt.timedelta(days=d), 5.0, 1.0, 12, 10, 10 + d, 2, "Clear", 0)
            for d in (0, 1, 2, 5, 6, 7, 8, 9, 10, 11)]
    df = spark.createDataFrame(rows, SALES_DDL)
    by_row = {r.date: r for r in fe.build_features(df).collect()}
    by_day = {r.date: r for r in fe.build_features(df, densify_days=True).collect()}
    gap_end = dt.date(2025, 6, 6)
    assert len(by_day) == len(rows)  # filled days are not returned
    assert by_row[gap_end].prev_day_demand == 12 and by_day[gap_end].prev_day_demand == 0
    d8 = dt.date(2025, 6, 8)  # 7 days earlier is 06-01 (demand 10); 7 rows earlier does not exist
    assert by_day[d8].prev_week_demand == 10 and by_row[d8].prev_week_demand == 0
    assert by_day[d8].rolling_3day_demand == np.mean([15, 16, 17])


def test_both_kinds_of_rolling_columns_at_once(spark):
    sales = spark.createDataFrame(sales_rows(40) + sales_rows(9, "Cafe", "Iced Tea 9"), SALES_DDL)
    both = fe.build_features(sales, include_current=None)
    assert len(fe.past_columns(both)) == 6
    for current in (True, False):
        want = fe.build_features(sales, include_current=current)
        got = fe.rolling_kind(both, current).select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
