"""Registered queries: data quality (Q*, U*, R*, S6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlake.operators import quality as qa
from demandlake.plans.registry import register
from demandlake.session import stored, work_dir
from demandlake.sources import testdata as td
from demandlake.sources.sales import read_sales_uploads, type_sales
from demandlake.sources.testdata import (
    DAY_REQUESTS_SQL,
    NAIVE_SQL,
    PLANS_SQL,
    RAW_SALES_SQL,
    REQUESTS_SQL,
    SALES_SQL,
    UPLOAD_LINES_SQL,
    UPLOADS_SQL,
    with_sql,
)

_ALL = ["business_type", "item_name", "date", "price", "shelf_life_hours", "quantity_available", "quantity_sold",
        "customer_demand", "waste_quantity", "weather_condition", "holiday_flag"]
_ANY_NULL = " OR ".join(f"{c} IS NULL" for c in _ALL)

_CHECKS_BODY = f"""
SELECT 'date_unparseable' AS rule, 'issue' AS level,
       count(*) FILTER (WHERE bad_date) AS n_failed FROM dirty
UNION ALL SELECT 'cell_unreadable', 'issue', count(*) FILTER (WHERE bad_cell) FROM dirty
UNION ALL SELECT 'has_null', 'issue', count(*) FILTER (WHERE {_ANY_NULL}) FROM dirty
UNION ALL SELECT 'negative_quantity_available', 'issue', count(*) FILTER (WHERE quantity_available < 0) FROM dirty
UNION ALL SELECT 'negative_quantity_sold', 'issue', count(*) FILTER (WHERE quantity_sold < 0) FROM dirty
UNION ALL SELECT 'negative_customer_demand', 'issue', count(*) FILTER (WHERE customer_demand < 0) FROM dirty
UNION ALL SELECT 'negative_waste_quantity', 'issue', count(*) FILTER (WHERE waste_quantity < 0) FROM dirty
UNION ALL SELECT 'sold_gt_available', 'issue', count(*) FILTER (WHERE quantity_sold > quantity_available) FROM dirty
UNION ALL SELECT 'sold_gt_demand', 'issue', count(*) FILTER (WHERE quantity_sold > customer_demand) FROM dirty
UNION ALL SELECT 'waste_mismatch', 'issue',
       count(*) FILTER (WHERE waste_quantity IS NULL OR quantity_available IS NULL OR quantity_sold IS NULL
                        OR waste_quantity <> greatest(quantity_available - quantity_sold, 0)) FROM dirty
UNION ALL SELECT 'price_not_positive', 'issue', count(*) FILTER (WHERE price <= 0) FROM dirty
UNION ALL SELECT 'shelf_life_negative', 'issue', count(*) FILTER (WHERE shelf_life_hours < 0) FROM dirty
UNION ALL SELECT 'weather_invalid', 'issue',
       count(*) FILTER (WHERE NOT coalesce(weather_condition IN ('Clear', 'Rainy'), false)) FROM dirty
UNION ALL SELECT 'holiday_invalid', 'issue', count(*) FILTER (WHERE NOT coalesce(holiday_flag IN (0, 1), false)) FROM dirty
UNION ALL SELECT 'continuity', 'warning',
       abs((date_diff('day', min(date), max(date)) + 1) * count(DISTINCT item_name) - count(*)) FROM dirty
UNION ALL SELECT 'duplicate_keys', 'issue', coalesce(sum(n), 0)
       FROM (SELECT count(*) AS n FROM dirty GROUP BY date, item_name HAVING count(*) > 1) d
UNION ALL SELECT 'missing_columns', 'issue', 0
"""
_CHECKS_SQL = with_sql(SALES_SQL, RAW_SALES_SQL) + _CHECKS_BODY


def _read(spark, sf_dir):
    """The dirty export as ``read_sales`` would type it, bad cells named. The checks read it more than once."""
    return stored(type_sales(td.raw_sales(td.load_sales(spark, sf_dir)), qa.BAD_CELLS), "typed")


@register("quality_sales_checks", "rule:s, level:s, n_failed:i", _CHECKS_SQL)
def quality_sales_checks(spark, sf_dir):
    """Q1-Q11: failures per rule over the daily sales table (duplicates on
    (date, item_name) without the business, as the reference checks)."""
    return qa.quality_checks(_read(spark, sf_dir))


@register("quality_uploads_checks", "rule:s, level:s, n_failed:i", with_sql(SALES_SQL, UPLOAD_LINES_SQL, """
dirty AS (SELECT *, false AS bad_date, false AS bad_cell FROM by_name)""") + _CHECKS_BODY + f"""
UNION ALL SELECT 'malformed_line', 'issue', count(*) FROM upload_lines
WHERE k IN ({td.LONG_LINE}, {td.SHORT_LINE}, {td.OPEN_LINE})""")
def quality_uploads_checks(spark, sf_dir):
    """Q1-Q11 over CSV uploads in three layouts: malformed lines are counted beside the row rules."""
    found = read_sales_uploads(
        spark, td.write_uploads(td.load_sales(spark, sf_dir), work_dir(spark, "uploads")), qa.BAD_CELLS)
    return qa.check_sales(found.rows, malformed=found.quarantine).checks


@register(
    "quality_sales_summary",
    "dataset:s, valid:b, n_issues:i, n_warnings:i, total_rows:i, date_range:s, issues:s",
    with_sql(SALES_SQL, RAW_SALES_SQL) + f""", checks AS (
{_CHECKS_BODY}
)
SELECT 'sales' AS dataset,
       count(*) FILTER (WHERE level = 'issue' AND n_failed > 0) = 0 AS valid,
       count(*) FILTER (WHERE level = 'issue' AND n_failed > 0) AS n_issues,
       count(*) FILTER (WHERE level = 'warning' AND n_failed > 0) AS n_warnings,
       (SELECT count(*) FROM dirty) AS total_rows,
       (SELECT CAST(min(date) AS VARCHAR) || ' to ' || CAST(max(date) AS VARCHAR) FROM dirty) AS date_range,
       coalesce(array_to_string(list_sort(list(rule || ': ' || CAST(n_failed AS VARCHAR)) FILTER (WHERE n_failed > 0)), '; '), '') AS issues
FROM checks""",
)
def quality_sales_summary(spark, sf_dir):
    """The one-row quality report of the sales table."""
    return qa.check_sales(_read(spark, sf_dir), "sales").summary


@register(
    "quality_upload",
    "valid:b, n_errors:i, n_warnings:i, rows:i, columns:s, errors:s, warnings:s",
    with_sql(UPLOADS_SQL) + """, c AS (
  SELECT count(*) AS rows,
         count(*) FILTER (WHERE date IS NOT NULL AND try_strptime(trim(date), '%Y-%m-%d') IS NULL) AS u0,
         count(*) FILTER (WHERE quantity_sold < 0) AS u1,
         count(*) FILTER (WHERE quantity_sold > quantity_available) AS u2,
         count(*) FILTER (WHERE item_name IS NULL) AS u3
  FROM uploads)
SELECT len(e) = 0 AS valid, len(e) AS n_errors, CASE WHEN u3 > 0 THEN 1 ELSE 0 END AS n_warnings, rows,
       'date,item_name,quantity_sold,quantity_available' AS columns, array_to_string(e, '; ') AS errors,
       CASE WHEN u3 > 0 THEN 'nulls in item_name: ' || u3 ELSE '' END AS warnings
FROM (SELECT *, list_filter([CASE WHEN u0 > 0 THEN 'date_invalid: ' || u0 END,
                             CASE WHEN u1 > 0 THEN 'negative_quantity_sold: ' || u1 END,
                             CASE WHEN u2 > 0 THEN 'sold_gt_available: ' || u2 END], lambda x: x IS NOT NULL) AS e FROM c) z""",
)
def quality_upload(spark, sf_dir):
    """The upload gate over an upload derived from lineitem."""
    return qa.check_upload(td.uploads(td.table(spark, sf_dir, "lineitem"), td.table(spark, sf_dir, "part")))


@register(
    "upload_quarantine",
    "date:s, item_name:s, quantity_sold:i, quantity_available:i, reasons:s",
    with_sql(UPLOADS_SQL) + """
SELECT * FROM (
  SELECT date, item_name, quantity_sold, quantity_available,
         array_to_string(list_filter([
           CASE WHEN date IS NOT NULL AND try_strptime(trim(date), '%Y-%m-%d') IS NULL THEN 'date_invalid' END,
           CASE WHEN quantity_sold < 0 THEN 'negative_quantity_sold' END,
           CASE WHEN quantity_sold > quantity_available THEN 'sold_gt_available' END], lambda x: x IS NOT NULL), ',') AS reasons
  FROM uploads) q WHERE reasons <> ''""",
)
def upload_quarantine(spark, sf_dir):
    """U2-U4 per row: quarantined upload rows with their reasons."""
    up = td.uploads(td.table(spark, sf_dir, "lineitem"), td.table(spark, sf_dir, "part"))
    _, bad = qa.split_valid(up, qa.upload_rules(up), levels=("error",))
    return bad.withColumn("reasons", F.array_join("reasons", ","))


@register(
    "requests_rejected",
    "request_id:i, item_name:s, business_type:s, reasons:s",
    with_sql(REQUESTS_SQL) + """
SELECT * FROM (
  SELECT request_id, item_name, business_type,
         array_to_string(list_filter([
           CASE WHEN coalesce(length(trim(item_name)) = 0, true) THEN 'item_name_empty' END,
           CASE WHEN NOT coalesce(business_type IN ('Restaurant', 'Cafe', 'Bakery'), false) THEN 'business_type_invalid' END,
           CASE WHEN NOT coalesce(price > 0, false) THEN 'price_not_positive' END,
           CASE WHEN NOT coalesce(shelf_life_hours > 0, false) THEN 'shelf_life_not_positive' END,
           CASE WHEN try_strptime(trim(starting_date), '%Y-%m-%d') IS NULL THEN 'starting_date_invalid' END,
           CASE WHEN NOT coalesce(len(weather_forecast) = 7, false) THEN 'weather_not_7' END,
           CASE WHEN NOT coalesce(list_bool_and(list_transform(weather_forecast, lambda x: coalesce(x IN ('Clear', 'Rainy'), false))), false)
                THEN 'weather_invalid' END,
           CASE WHEN NOT coalesce(len(holiday_flags) = 7, false) THEN 'holidays_not_7' END,
           CASE WHEN NOT coalesce(list_bool_and(list_transform(holiday_flags, lambda x: coalesce(x IN (0, 1), false))), false)
                THEN 'holiday_invalid' END], lambda x: x IS NOT NULL), ',') AS reasons
  FROM requests) r WHERE reasons <> ''""",
)
def requests_rejected(spark, sf_dir):
    """Week-forecast requests that fail validation, with reasons."""
    _, bad = qa.validate_requests(td.week_requests(td.table(spark, sf_dir, "part")))
    return bad.withColumn("reasons", F.array_join("reasons", ","))


@register(
    "day_requests_rejected",
    "request_id:i, item_name:s, business_type:s, reasons:s",
    with_sql(REQUESTS_SQL, DAY_REQUESTS_SQL) + """
SELECT * FROM (
  SELECT request_id, item_name, business_type,
         array_to_string(list_filter([
           CASE WHEN coalesce(length(trim(item_name)) = 0, true) THEN 'item_name_empty' END,
           CASE WHEN NOT coalesce(business_type IN ('Restaurant', 'Cafe', 'Bakery'), false) THEN 'business_type_invalid' END,
           CASE WHEN NOT coalesce(price > 0, false) THEN 'price_not_positive' END,
           CASE WHEN NOT coalesce(shelf_life_hours > 0, false) THEN 'shelf_life_not_positive' END,
           CASE WHEN try_strptime(trim(date), '%Y-%m-%d') IS NULL THEN 'date_invalid' END,
           CASE WHEN NOT coalesce(coalesce(weather, 'Clear') IN ('Clear', 'Rainy'), false) THEN 'weather_invalid' END,
           CASE WHEN NOT coalesce(coalesce(is_holiday, 0) IN (0, 1), false) THEN 'holiday_invalid' END],
           lambda x: x IS NOT NULL), ',') AS reasons
  FROM day_requests) r WHERE reasons <> ''""",
)
def day_requests_rejected(spark, sf_dir):
    """R1-R3 + R5: single-day requests that fail validation, with reasons
    (weather defaults to 'Clear', holiday flag to 0)."""
    _, bad = qa.validate_day_requests(td.day_requests(td.table(spark, sf_dir, "part")))
    return bad.withColumn("reasons", F.array_join("reasons", ","))


@register(
    "quality_missing_column",
    "rule:s, n_failed:i",
    with_sql(SALES_SQL) + "SELECT 'missing_columns' AS rule, 2 AS n_failed WHERE (SELECT count(*) FROM sales) >= 0",
)
def quality_missing_column(spark, sf_dir):
    """Q1: a sales table without price and weather."""
    checks = qa.quality_checks(td.load_sales(spark, sf_dir).drop("price", "weather_condition"))
    return checks.where(F.col("rule") == "missing_columns")


@register(
    "upload_missing_column",
    "valid:b, rows:i, errors:s",
    with_sql(UPLOADS_SQL) + """SELECT false AS valid, count(*) AS rows, array_to_string(list_filter([
  'missing_columns: quantity_sold',
  CASE WHEN count(*) FILTER (WHERE date IS NOT NULL AND try_strptime(trim(date), '%Y-%m-%d') IS NULL) > 0 THEN 'date_invalid: '
    || count(*) FILTER (WHERE date IS NOT NULL AND try_strptime(trim(date), '%Y-%m-%d') IS NULL) END], lambda x: x IS NOT NULL),
  '; ') AS errors FROM uploads""",
)
def upload_missing_column(spark, sf_dir):
    """An upload without a required column."""
    up = td.uploads(td.table(spark, sf_dir, "lineitem"), td.table(spark, sf_dir, "part"))
    return qa.check_upload(up.drop("quantity_sold"))


_SIGNED = "CAST(planned_quantity - 60 AS BIGINT) AS planned_quantity"


@register(
    "plan_requests_rejected",
    "business_type:s, item_name:s, date:t, predicted_demand:i, planned_quantity:i, reasons:s",
    with_sql(SALES_SQL, NAIVE_SQL, PLANS_SQL) + f"""SELECT business_type, item_name, date, predicted_demand, planned_quantity,
       'planned_quantity_negative' AS reasons FROM (SELECT * REPLACE ({_SIGNED}) FROM plans) p WHERE planned_quantity < 0""",
)
def plan_requests_rejected(spark, sf_dir):
    """Plans reduced by 60 units; the negative ones are rejected."""
    plans = td.plans(td.load_sales(spark, sf_dir)).withColumn("planned_quantity", F.col("planned_quantity") - 60)
    _, bad = qa.validate_plans(plans)
    return bad.withColumn("reasons", F.array_join("reasons", ","))
