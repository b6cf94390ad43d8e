"""Quality rules (Q*, U*, R*) including the reference's upload cases."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import SALES_DDL, sales_rows
from demandlake.operators import quality as qa
from demandlake.sources.testdata import week_requests


def test_upload_reference_cases(spark):
    ok = spark.createDataFrame([("2025-06-01", "Jollof Rice", 40, 45), ("2025-06-02", "Jollof Rice", 42, 45)],
                               "date string, item_name string, quantity_sold bigint, quantity_available bigint")
    assert qa.check_upload(ok).first().valid
    missing = spark.createDataFrame([("2025-06-01", "Jollof Rice")], "date string, item_name string")
    r = missing.transform(qa.check_upload).first()
    assert not r.valid and "missing_columns" in r.errors
    neg = spark.createDataFrame([("2025-06-01", "Jollof Rice", -5)], "date string, item_name string, quantity_sold bigint")
    assert not qa.check_upload(neg).first().valid


def test_upload_bad_date_and_strict(spark):
    df = spark.createDataFrame([("2025-13-01", "Latte", 1, 2), ("2025-06-01", "Latte", 3, None)],
                               "date string, item_name string, quantity_sold bigint, quantity_available bigint")
    r = qa.check_upload(df).first()
    assert not r.valid and r.n_warnings == 1 and "date_invalid: 1" in r.errors
    assert "missing_columns" in qa.check_upload(df.where("quantity_available is not null"), strict=True).first().errors


def test_sales_checks_counts(spark):
    rows = sales_rows(10)
    rows.append(rows[0])  # exact duplicate of (date, item)
    rows.append(("Cafe", "Jollof Rice", dt.date(2025, 6, 2), 50.0, 4.0, 5, 6, 4, None, "Snowy", 2))
    df = spark.createDataFrame(rows, SALES_DDL)
    got = {r.rule: r.n_failed for r in qa.quality_checks(df).collect()}
    assert got["duplicate_keys"] == 4  # two groups of two rows, all rows counted
    assert got["has_null"] == 1 and got["waste_mismatch"] == 1
    assert got["sold_gt_available"] == 1 and got["sold_gt_demand"] == 1
    assert got["weather_invalid"] == 1 and got["holiday_invalid"] == 1
    assert got["continuity"] == 2 and got["missing_columns"] == 0
    s = qa.check_sales(df, "fixture").summary.first()
    assert not s.valid and s.total_rows == 12 and s.date_range == "2025-06-01 to 2025-06-10"


def test_clean_sales_valid(spark):
    df = spark.createDataFrame(sales_rows(14), SALES_DDL)
    s = qa.quality_summary(df, "clean").first()
    assert s.valid and s.n_warnings == 0 and s.issues == ""


def test_split_valid_reasons(spark):
    df = spark.createDataFrame(sales_rows(3) + [("Cafe", "X", dt.date(2025, 6, 1), -1.0, 4.0, 1, 1, 1, 0, None, 0)],
                               SALES_DDL)
    good, bad = qa.split_valid(df, qa.sales_row_rules(df))
    assert good.count() == 3
    r = bad.first()
    assert set(r.reasons) == {"has_null", "price_not_positive", "weather_invalid"}


def test_request_rules(spark):
    part = spark.createDataFrame([(k, f"name {k}", s) for k, s in [(10, 1), (11, 2), (12, 3), (13, 4), (14, 5),
                                                                    (15, 6), (60, 9), (16, 9)]],
                                 "p_partkey bigint, p_name string, p_size int").withColumn("p_retailprice", F.lit(1.0))
    ok, bad = qa.validate_requests(week_requests(part))
    reasons = {r.request_id: r.reasons for r in bad.collect()}
    assert reasons[10] == ["item_name_empty"]
    assert reasons[11] == ["business_type_invalid"]
    assert reasons[12] == ["starting_date_invalid"]
    assert reasons[13] == ["weather_not_7"]
    assert reasons[14] == ["weather_invalid"]
    assert reasons[15] == ["holiday_invalid"]
    assert reasons[60] == ["price_not_positive"]
    assert [r.request_id for r in ok.collect()] == [16]


def test_items_are_counted_without_copies_of_the_rows(spark):
    rows = sales_rows(12) + sales_rows(3, "Cafe", "Tea")
    df = spark.createDataFrame([*rows, ("Cafe", None, *rows[0][2:])], SALES_DDL)
    checks = qa.quality_checks(df)
    assert "Expand" not in checks._jdf.queryExecution().optimizedPlan().toString()
    got = {r.rule: r.n_failed for r in checks.collect()}
    assert got["continuity"] == 12 * 2 - 16
    empty = {r.rule: r.n_failed for r in qa.quality_checks(df.limit(0)).collect()}
    assert set(empty.values()) == {0}
