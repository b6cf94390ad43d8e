"""Windows over ranges with a halo, and merged daily states, against whole windows and recomputation."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlake.operators import daystates as ds
from demandlake.operators import features as fe
from demandlake.operators.splitwindows import split_windows

DDL = "business_type string, item_name string, date date, line int, customer_demand bigint, quantity_sold bigint, waste_quantity bigint"
DAY = dt.date(2020, 1, 1)


def raw(seed):
    """One series holds a third of all rows, several on a day; some series are short, one has null names."""
    r, rows = random.Random(seed), []
    for b, i, n in [("Cafe", "hot", 700), ("Cafe", "x", 1), ("Bakery", None, 90), *[("Cafe", f"s{k}", r.randint(2, 60)) for k in range(40)]]:
        for k in range(n):
            v = r.choice([None, *range(50)])
            rows.append((b, i, DAY + dt.timedelta(days=k // 3), k, v, v, 1))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("n_ranges", [1, 7, 64, 500])
@pytest.mark.parametrize("current", [True, False])
def test_split_windows_equal_whole_windows(spark, n_ranges, current):
    df = spark.createDataFrame(raw(1), DDL).repartition(5)

    def columns(keys, order):
        return {**fe.lag_columns(keys, order), **fe.rolling_columns(keys=keys, order=order, include_current=current)}

    got = split_windows(df, columns, ["date", "line"], n_ranges=n_ranges)
    want = df.withColumn("_o", F.struct("date", "line")).withColumns(columns(["business_type", "item_name"], "_o")).drop("_o")
    assert got.columns == want.columns
    rows = lambda d: sorted([tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in d.collect()], key=str)
    assert rows(got) == rows(want)


def test_a_hot_series_runs_in_many_tasks(spark):
    df = spark.createDataFrame(raw(2), DDL)
    cut = df.repartitionByRange(16, "business_type", "item_name", F.struct("date", "line")).withColumn("r", F.spark_partition_id())
    assert cut.where("item_name = 'hot'").select("r").distinct().count() >= 5
    assert split_windows(df.limit(0), lambda k, o: fe.lag_columns(k, o), ["date", "line"]).count() == 0


def test_ranges_of_days_equal_recomputation(spark, tmp_path):
    r, folder = np.random.default_rng(3), str(tmp_path / "states")
    rows = [("Cafe" if k % 3 else "Bakery", f"i{r.integers(300)}", DAY + dt.timedelta(days=int(r.integers(30))), k,
             None if k % 97 == 0 else int(r.lognormal(3, 1.5)), 1, 1) for k in range(6000)]
    df = spark.createDataFrame(rows, DDL)
    ds.write_states(df.where("date < '2020-01-20'"), folder)
    ds.write_states(df.where("date >= '2020-01-18'"), folder)  # two days are written again
    for first, last in (("2020-01-05", "2020-01-25"), ("2020-01-18", "2020-01-18"), ("2019-01-01", "2021-01-01")):
        got = {x.business_type: x for x in ds.range_summary(spark, folder, first, last, (0.1, 0.5, 0.99)).collect()}
        part = [x for x in rows if first <= str(x[2]) <= last and x[4] is not None]
        for b, x in got.items():
            v = np.sort([p[4] for p in part if p[0] == b]).astype(float)
            assert (x.n, x.least, x.largest) == (len(v), v.min(), v.max())
            assert abs(x["mean"] - v.mean()) < 1e-9 and abs(x["std"] - v.std(ddof=1)) < 1e-6
            for i, q in enumerate((0.1, 0.5, 0.99)):
                exact = v[int(np.ceil(q * len(v))) - 1]
                assert abs(x[f"q{i}"] - exact) <= ds.QUANTILE_ERROR * exact + 1e-9
            items = len({p[1] for p in part if p[0] == b})
            assert abs(x.n_items - items) <= 0.05 * items + 1
    assert ds.range_summary(spark, folder, "2030-01-01", "2030-01-02").count() == 0
    plan = ds.range_summary(spark, folder, "2020-01-05", "2020-01-06")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
