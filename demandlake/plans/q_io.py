"""Registered queries: readers and writers.

Files are written under the session's checkpoint folder (the shared folder
the cluster names), each run in a fresh sub-folder."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from demandlake.operators import quality as qa
from demandlake.operators import windows as wn
from demandlake.plans.registry import register
from demandlake.session import work_dir
from demandlake.sources import sales as io
from demandlake.sources import testdata as td
from demandlake.sources.testdata import NAIVE_SQL, SALES_SQL, UPLOAD_LINES_SQL, with_sql

SALES_COLS = ("business_type:s, item_name:s, date:t, price:d, shelf_life_hours:d, quantity_available:i, "
              "quantity_sold:i, customer_demand:i, waste_quantity:i, weather_condition:s, holiday_flag:i")


def _scratch(spark, name: str) -> str:
    return work_dir(spark, name)


@register("sales_csv_roundtrip", SALES_COLS, with_sql(SALES_SQL) + "SELECT * FROM sales")
def sales_csv_roundtrip(spark, sf_dir):
    """S1 + S2: the sales table written as two headered CSV datasets
    (restaurant, cafe+bakery), read back with the declared schema and
    concatenated by column name."""
    base = _scratch(spark, "csv")
    sales = td.load_sales(spark, sf_dir)
    # one pass writes both datasets; each keeps its business column in the files
    half = F.when(F.col("business_type") == "Restaurant", "restaurant").otherwise("cafe_bakery")
    sales.withColumn("dataset", half).write.partitionBy("dataset").option("header", True).csv(base)
    parts = [os.path.join(base, f"dataset={d}") for d in ("restaurant", "cafe_bakery")]
    return io.union_sales(*(io.read_sales(spark, p) for p in parts))


@register("sales_preview", SALES_COLS, with_sql(SALES_SQL) + "SELECT * FROM sales ORDER BY business_type, item_name, date LIMIT 20")
def sales_preview(spark, sf_dir):
    """The first 20 rows in series order."""
    return io.preview(td.load_sales(spark, sf_dir), 20)


@register("sales_sorted", SALES_COLS, with_sql(SALES_SQL) + "SELECT * FROM sales ORDER BY business_type, item_name, date")
def sales_sorted(spark, sf_dir):
    """the sales table in series and date order."""
    return wn.sort_series(td.load_sales(spark, sf_dir))


@register("history_partition_read", SALES_COLS,
          with_sql(SALES_SQL) + "SELECT * FROM sales WHERE business_type = 'Cafe'")
def history_partition_read(spark, sf_dir):
    """S3: history written as Parquet partitioned by business type; a
    reader of one business prunes to its partition."""
    path = io.write_history(td.load_sales(spark, sf_dir), os.path.join(_scratch(spark, "history"), "v1"))
    return io.read_history(spark, path).where(F.col("business_type") == "Cafe")


@register(
    "metrics_log_append",
    "business_type:s, item_name:s, mae:d, mape:d, rmse:d, r2:d, n_predictions:i",
    with_sql(SALES_SQL, NAIVE_SQL) + """SELECT business_type, item_name, round(avg(abs(y_true - y_pred)), 2) AS mae,
       round(avg(abs(y_true - y_pred) / greatest(abs(y_true), 2.220446049250313e-16)) * 100.0, 2) AS mape,
       round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 2) AS rmse,
       CAST(round(CAST(CASE WHEN var_pop(y_true) * count(y_true) = 0
            THEN CASE WHEN sum((y_true - y_pred) * (y_true - y_pred)) = 0 THEN 1.0 ELSE 0.0 END
            ELSE 1.0 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(y_true)) END AS DECIMAL(38, 9)), 3) AS DOUBLE) AS r2,
       count(y_true) AS n_predictions
FROM naive WHERE business_type <> 'Bakery' GROUP BY 1, 2
UNION ALL
SELECT business_type, item_name, round(avg(abs(y_true - y_pred)), 2),
       round(avg(abs(y_true - y_pred) / greatest(abs(y_true), 2.220446049250313e-16)) * 100.0, 2),
       round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 2),
       CAST(round(CAST(CASE WHEN var_pop(y_true) * count(y_true) = 0
            THEN CASE WHEN sum((y_true - y_pred) * (y_true - y_pred)) = 0 THEN 1.0 ELSE 0.0 END
            ELSE 1.0 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(y_true)) END AS DECIMAL(38, 9)), 3) AS DOUBLE),
       count(y_true)
FROM naive WHERE business_type = 'Bakery' GROUP BY 1, 2""",
)
def metrics_log_append(spark, sf_dir):
    """S4 + O1: two scoring runs appended to one accuracy log (never
    rewritten whole) and read back with the log schema."""
    from demandlake.operators.monitor import score_actuals

    path = os.path.join(_scratch(spark, "metrics"), "log")
    pairs = td.naive_pairs(td.load_sales(spark, sf_dir))
    stamp = F.current_timestamp()
    io.append_metrics(score_actuals(pairs.where(F.col("business_type") != "Bakery")).withColumn("timestamp", stamp), path)
    io.append_metrics(score_actuals(pairs.where(F.col("business_type") == "Bakery")).withColumn("timestamp", stamp), path)
    return io.read_metrics(spark, path).drop("timestamp")


def _uploads(spark, sf_dir):
    """The sales table as CSV uploads in three layouts, read by name."""
    paths = td.write_uploads(td.load_sales(spark, sf_dir), _scratch(spark, "uploads"))
    return io.read_sales_uploads(spark, paths, qa.BAD_CELLS)


def _layout():
    return F.regexp_extract("file", "layout=([a-z]+)", 1).alias("layout")


_BROKEN = f"k IN ({td.LONG_LINE}, {td.SHORT_LINE}, {td.OPEN_LINE})"


@register("uploads_by_name", SALES_COLS, with_sql(SALES_SQL, UPLOAD_LINES_SQL) + "SELECT * FROM by_name")
def uploads_by_name(spark, sf_dir):
    """S1 + S2: files with shuffled, extra and missing columns, each read by its own header."""
    return _uploads(spark, sf_dir).rows


@register("uploads_quarantine", "layout:s, text:s, n_expected:i", with_sql(SALES_SQL, UPLOAD_LINES_SQL) +
          f"SELECT layout, line AS text, width AS n_expected FROM upload_lines WHERE {_BROKEN}")
def uploads_quarantine(spark, sf_dir):
    """Lines with a cell too many, too few, or an open quote, kept as they are."""
    return _uploads(spark, sf_dir).quarantine.select(_layout(), "text", "n_expected")


@register("uploads_report", "layout:s, n_rows:i, n_malformed:i, missing:s, unknown:s",
          with_sql(SALES_SQL, UPLOAD_LINES_SQL) + f"""
SELECT layout, count(*) FILTER (WHERE NOT {_BROKEN}) AS n_rows, count(*) FILTER (WHERE {_BROKEN}) AS n_malformed,
       CASE layout WHEN 'bakery' THEN 'holiday_flag' ELSE '' END AS missing,
       CASE layout WHEN 'restaurant' THEN 'note' ELSE '' END AS unknown
FROM upload_lines GROUP BY layout""")
def uploads_report(spark, sf_dir):
    """Counts and column differences of the files, by layout."""
    return _uploads(spark, sf_dir).files.groupBy(_layout()).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_malformed").alias("n_malformed"), F.max("missing").alias("missing"),
        F.max("unknown").alias("unknown"))
