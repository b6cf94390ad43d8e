"""Cases that once gave wrong answers: R2 of large values, null predictions,
gaps in weekly runs, 4xx statuses, unreadable cells, bursts across buckets."""

import datetime as dt
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from demandlake.operators import monitor as mo
from demandlake.operators import quality as qa
from demandlake.sources.sales import read_sales


def test_r2_of_large_values(spark):
    rng = np.random.default_rng(3)
    y = 1e9 + rng.random(3000)
    p = np.full(3000, y.mean())
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y_true double, y_pred double")
    want = 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert abs(mo.accuracy(df).first()["r2"] - want) < 1e-6


def test_metrics_use_complete_pairs(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, None), (3.0, 3.5), (None, 4.0)], "y_true double, y_pred double")
    r = mo.accuracy(df).first()
    assert (r["n_predictions"], r["n_excluded"], r["mae"], r["r2"]) == (2, 2, 0.25, 0.875)


def test_rising_weeks_need_neighbouring_weeks(spark):
    def log(days):
        return spark.createDataFrame([("Cafe", "Latte", dt.datetime(2025, 1, 6) + dt.timedelta(days=d), float(i))
                                      for i, d in enumerate(days)],
                                     "business_type string, item_name string, timestamp timestamp, mape double")

    assert mo.rising_weeks(log([0, 28, 91, 140])).count() == 0
    assert mo.rising_weeks(log([0, 7, 14, 21])).count() == 1


def test_client_errors_count_as_errors(spark):
    df = spark.createDataFrame([("a", 404, 0.1, False), ("a", 200, 0.1, False)],
                               "endpoint string, status int, latency_s double, fallback boolean")
    assert mo.request_metrics(df).first()["error_rate"] == 0.5


def test_unreadable_cells_are_counted(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="csv-", dir="/tmp"), "s.csv")
    head = ("business_type,item_name,date,price,shelf_life_hours,quantity_available,quantity_sold,customer_demand,"
            "waste_quantity,weather_condition,holiday_flag")
    rows = ["Cafe,Latte,2025-06-01,20,1,12.7,5,5,0,Clear,0", "Cafe,Latte,2025-13-01,20,1,12.0,5,5,7,Clear,0",
            "Cafe,Latte,2025-06-03,20,1,12,5,5,7,Clear,0"]
    with open(path, "w") as f:
        f.write("\n".join([head, *rows]))
    df = read_sales(spark, path, bad_cells=qa.BAD_CELLS)
    got = {r["rule"]: r["n_failed"] for r in qa.check_sales(df).checks.collect()}
    assert got["date_unparseable"] == 1 and got["cell_unreadable"] == 1
    assert [r.quantity_available for r in df.orderBy("waste_quantity", "date").collect()] == [None, 12, 12]


def test_failure_runs_with_good_only_buckets(spark):
    rng = np.random.default_rng(5)
    bad = np.concatenate([np.ones(700, bool), np.zeros(500, bool), rng.random(800) < 0.5, np.ones(400, bool)])
    rows = [(i, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=i // 3), bool(b)) for i, b in enumerate(bad)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, failed boolean").repartition(5)
    want, k = [], 0
    for b in [*bad.tolist(), False]:
        if b:
            k += 1
        elif k:
            want.append(k)
            k = 0
    for n in (1, 3, 16, 64):
        got = [r.n_events for r in mo.failure_islands(df, n_ranges=n).collect()]
        assert sorted(got) == sorted(want), n
    assert mo.failure_islands(df.where(~F.col("failed"))).count() == 0
