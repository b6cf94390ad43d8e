"""Steps whose tasks must not grow with the table: days without a row, the tail of a business, the series windows."""

import datetime as dt
from collections import Counter

from conftest import SALES_DDL, sales_rows
from pyspark.sql import functions as F

from demandlake.operators import eda
from demandlake.operators import features as fe
from demandlake.operators import windows as wn
from demandlake.sources import testdata as td

DAY = dt.date(2025, 2, 26)
KEYS = ["business_type", "item_name"]
ROWS = [("Cafe", "tea", 0, 5), ("Cafe", "tea", 4, 6), ("Cafe", "tea", 4, 7), ("Cafe", "tea", 5, 1), ("Cafe", "bun", 2, 3),
        ("Cafe", None, 0, 4), ("Cafe", None, 2, 9), ("Bakery", "rye", None, 8), ("Bakery", "rye", 1, 2), ("Bakery", "rye", 3, 2),
        (None, "rye", None, 1)]


def frame(spark):
    rows = [(b, i, None if d is None else DAY + dt.timedelta(days=d), n) for b, i, d, n in ROWS]
    return spark.createDataFrame(rows, "business_type string, item_name string, date date, customer_demand bigint")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def missing():
    """Days between a series' first and last without a row; no day of a series with a null key counts as present."""
    out = Counter()
    for b, i in {r[:2] for r in ROWS}:
        days = {r[2] for r in ROWS if r[:2] == (b, i) and r[2] is not None}
        for d in range(min(days, default=0), max(days, default=-1) + 1):
            if d not in days or b is None or i is None:
                out[b, i, DAY + dt.timedelta(days=d)] += 1
    return out


def test_missing_days_come_from_neighbouring_days(spark):
    got = eda.missing_dates(frame(spark), by=KEYS)
    assert Counter(map(tuple, got.collect())) == missing()
    assert "LeftAnti" not in plan_of(got)


def test_dense_rows_without_a_join(spark):
    df = frame(spark)
    dense = fe.densify(df)
    assert "Join" not in plan_of(dense) and dense.columns == [*df.columns, fe.FILLED]
    rows = dense.collect()
    assert Counter(tuple(r)[:4] for r in rows if not r[fe.FILLED]) == Counter(map(tuple, df.collect()))
    filled = [r for r in rows if r[fe.FILLED]]
    assert Counter(tuple(r)[:3] for r in filled) == missing() and all(r.customer_demand is None for r in filled)


def test_the_tail_of_a_business_without_a_join(spark):
    df = frame(spark)
    tail = wn.business_tail(df, 2)
    assert "Join" not in plan_of(tail)
    got = sorted((r.business_type, r.item_name, r.date, r.customer_demand) for r in tail.where("date <> '2025-03-02'").collect())
    day = lambda k: DAY + dt.timedelta(days=k)
    assert got == [("Bakery", "rye", day(1), 2), ("Bakery", "rye", day(3), 2), ("Cafe", "tea", day(5), 1)]
    assert tail.where("business_type is null").count() == 0


def test_series_windows_are_dealt_by_the_size_of_the_table(spark, monkeypatch, tmp_path):
    spark.range(950).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(td, "SERIES_TASK_ROWS", 25)
    assert td.series_parts(spark, str(tmp_path)) == 38
    sales = spark.createDataFrame(sales_rows(20) + sales_rows(12, "Cafe", "Latte"), SALES_DDL)
    dealt = td.naive_pairs(sales, parts=38)
    assert dealt.rdd.getNumPartitions() == 38
    assert Counter(map(tuple, dealt.collect())) == Counter(map(tuple, td.naive_pairs(sales).collect()))
    few = td.naive_pairs(sales, parts=2)
    assert few.count() == 18 and "RepartitionByExpression" not in plan_of(few)
    log = td.accuracy_log(sales, 38).select(F.sum("n_predictions")).first()[0]
    assert log == 18
