"""Backtests of many origins at once equal one forecast per origin; scores by band equal numpy."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from demandlake.plans import backtest as bt
from demandlake.plans import forecast as fc
from demandlake.plans.q_forecast_fixed import FixedLinear
from tests.conftest import SALES_DDL, sales_rows


def history(spark):
    rows = sales_rows(60) + sales_rows(50, "Cafe", "Espresso", dt.date(2025, 6, 5), price=25.0, shelf=0.5)
    rows += [r for r in sales_rows(60, "Bakery", "Odd Bun", price=12.0) if r[2].day % 3]  # gaps
    rows += sales_rows(4, "Bakery", "Late", dt.date(2025, 7, 28))
    return spark.createDataFrame(rows, SALES_DDL)


def test_all_origins_at_once_equal_one_forecast_each(spark):
    sales = history(spark)
    got = {}
    for r in bt.backtest(FixedLinear(), sales, bt.weekly_origins(sales, 4)).collect():
        got.setdefault(r.origin, {})[r.business_type, r.item_name, r.date] = (r.day_number, r.y_true, r.y_pred)
    last = dt.date(2025, 7, 31)
    assert sorted(got) == [last - dt.timedelta(days=7 * k) for k in (4, 3, 2, 1)]
    facts = {(r.business_type, r.item_name, r.date): r for r in sales.collect()}
    for origin, rows in got.items():
        past = sales.where(F.col("date") <= F.lit(origin))
        days = [origin + dt.timedelta(days=k + 1) for k in range(7)]
        requests = []
        for b, i in sorted({(b, i) for b, i, _ in facts}):
            mine = sorted(d for x, y, d in facts if (x, y) == (b, i) and d <= origin)
            if mine and any((b, i, d) in facts for d in days):
                f, known = facts[b, i, mine[-1]], [facts.get((b, i, d)) for d in days]
                requests.append((f"{b}|{i}", i, b, f.price, f.shelf_life_hours, str(days[0]),
                                 [k.weather_condition if k else "Clear" for k in known], [k.holiday_flag if k else 0 for k in known]))
        df = spark.createDataFrame(requests, "request_id string, item_name string, business_type string, price double, "
                                   "shelf_life_hours double, starting_date string, weather_forecast array<string>, holiday_flags array<int>")
        want = {}
        for r in fc.forecast(FixedLinear(), past, df).collect():
            key = (r.business_type, r.item_name, dt.date.fromisoformat(r.date))
            if key in facts:
                want[key] = (r.day_number, float(facts[key].customer_demand), float(r.predicted_demand))
        assert rows == want
    assert not any(i == "Late" for rows in list(got.values())[:1] for _, i, _ in rows)


def test_scores_by_band(spark):
    r = np.random.default_rng(2)
    rows = [("Cafe" if k % 2 else "Bakery", 1 + k % 7, float(r.integers(1, 50)), float(r.integers(1, 50))) for k in range(300)]
    df = spark.createDataFrame(rows, "business_type string, day_number int, y_true double, y_pred double")
    got = {(x.band, x.business_type): x for x in bt.score_by_horizon(df).collect()}
    assert len(got) == 9
    for (band, business), x in got.items():
        first, last = map(int, band.split("-"))
        part = np.array([(y, p) for b, d, y, p in rows if first <= d <= last and business in (b, "All")])
        assert x.n_predictions == len(part) and abs(x.mae - np.abs(part[:, 0] - part[:, 1]).mean()) < 1e-9


def test_states_take_only_the_rows_near_an_origin(spark):
    rows = sales_rows(400, start=dt.date(2024, 6, 27)) + sales_rows(300, "Cafe", "Tea", dt.date(2024, 1, 1))
    sales = spark.createDataFrame(rows, SALES_DDL)
    origins = bt.weekly_origins(sales, 2)
    near = bt.near_rows(sales, origins)
    assert {r.item_name: r["count"] for r in near.groupBy("item_name").count().collect()} == {"Jollof Rice": 30 + 14, "Tea": 30}
    states = {r.origin: r for r in bt.origin_states(sales, origins).collect()}
    days = sorted(r[2] for r in rows if r[1] == "Jollof Rice")
    assert sorted(states) == [days[-15], days[-8]]
    for origin, r in states.items():
        assert [h.date for h in r.hist] == [d for d in days if d <= origin][-30:]
        assert [a.date for a in r.actuals] == [d for d in days if d > origin][:7]
    shared = bt.origin_states(sales, origins)
    got = bt.backtest(FixedLinear(), sales, origins, states=shared).collect()
    assert sorted(got) == sorted(bt.backtest(FixedLinear(), sales, origins).collect())
