"""Registered queries: exploratory aggregates A1-A16."""

from __future__ import annotations

from demandlake.operators import daystates as ds
from demandlake.operators import eda
from demandlake.plans.registry import register
from demandlake.session import work_dir
from demandlake.sources import testdata as td
from demandlake.sources.sales import type_sales
from demandlake.sources.testdata import RAW_SALES_SQL, SALES_SQL, with_sql

S = with_sql(SALES_SQL)


def _sales(spark, sf_dir):
    return td.load_sales(spark, sf_dir)


def _unpivot_sql(cols, select_for) -> str:
    return "\nUNION ALL\n".join(select_for(c) for c in cols)


_SALES_COLS = [
    ("business_type", "STRING"), ("item_name", "STRING"), ("date", "DATE"), ("price", "DOUBLE"),
    ("shelf_life_hours", "DOUBLE"), ("quantity_available", "BIGINT"), ("quantity_sold", "BIGINT"),
    ("customer_demand", "BIGINT"), ("waste_quantity", "BIGINT"), ("weather_condition", "STRING"),
    ("holiday_flag", "INT"),
]
_SPARK_TYPE = {"STRING": "string", "DATE": "date", "DOUBLE": "double", "BIGINT": "bigint", "INT": "int"}


@register(
    "eda_columns",
    "column:s, dtype:s, non_null:i",
    S + _unpivot_sql(
        _SALES_COLS,
        lambda c: f"SELECT '{c[0]}' AS \"column\", '{_SPARK_TYPE[c[1]]}' AS dtype, count({c[0]}) AS non_null FROM sales",
    ),
)
def eda_columns(spark, sf_dir):
    """A1: type and non-null count per column."""
    return eda.overview_columns(_sales(spark, sf_dir))


@register(
    "eda_describe",
    "column:s, count:i, mean:d, std:d, min:d, p25:d, p50:d, p75:d, max:d",
    S + _unpivot_sql(
        eda.DESCRIBE_COLS,
        lambda c: (f"SELECT '{c}' AS \"column\", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
                   f"min({c}) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, "
                   f"quantile_cont({c}, 0.75) AS p75, max({c}) AS max FROM sales"),
    ),
)
def eda_describe(spark, sf_dir):
    """A2: count, mean, std, min, exact quartiles, max."""
    return eda.describe(_sales(spark, sf_dir))


@register("eda_rows_by_business", "business_type:s, n_rows:i",
          S + "SELECT business_type, count(*) AS n_rows FROM sales GROUP BY 1")
def eda_rows_by_business(spark, sf_dir):
    """A3: row count per business type."""
    return eda.count_by(_sales(spark, sf_dir))


@register("eda_items_per_business", "business_type:s, n_items:i",
          S + "SELECT business_type, count(DISTINCT item_name) AS n_items FROM sales GROUP BY 1")
def eda_items_per_business(spark, sf_dir):
    """A4: distinct items per business type."""
    return eda.distinct_items(_sales(spark, sf_dir))


@register(
    "eda_null_counts",
    "column:s, n_null:i",
    with_sql(SALES_SQL, RAW_SALES_SQL) + _unpivot_sql(
        _SALES_COLS, lambda c: f"SELECT '{c[0]}' AS \"column\", count(*) - count({c[0]}) AS n_null FROM dirty"),
)
def eda_null_counts(spark, sf_dir):
    """A5: null count per column."""
    return eda.null_counts(type_sales(td.raw_sales(_sales(spark, sf_dir))))


@register(
    "eda_violations",
    "negative_sold:i, negative_available:i, sold_gt_available:i, sold_gt_demand:i",
    with_sql(SALES_SQL, RAW_SALES_SQL) + """SELECT count(*) FILTER (WHERE quantity_sold < 0) AS negative_sold,
                  count(*) FILTER (WHERE quantity_available < 0) AS negative_available,
                  count(*) FILTER (WHERE quantity_sold > quantity_available) AS sold_gt_available,
                  count(*) FILTER (WHERE quantity_sold > customer_demand) AS sold_gt_demand
           FROM dirty""",
)
def eda_violations(spark, sf_dir):
    """Rule-violation counts."""
    return eda.violations(type_sales(td.raw_sales(_sales(spark, sf_dir))))


@register(
    "eda_missing_dates",
    "date:t",
    S + """SELECT CAST(d AS DATE) AS date
           FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM sales) g
           WHERE CAST(d AS DATE) NOT IN (SELECT date FROM sales)""",
)
def eda_missing_dates(spark, sf_dir):
    """Calendar days with no sales row over the whole table."""
    return eda.missing_dates(_sales(spark, sf_dir))


@register(
    "eda_missing_dates_by_series",
    "business_type:s, item_name:s, date:t",
    S + """SELECT g.business_type, g.item_name, CAST(g.d AS DATE) AS date
           FROM (SELECT business_type, item_name, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d
                 FROM sales GROUP BY 1, 2) g
           ANTI JOIN sales s ON s.business_type = g.business_type AND s.item_name = g.item_name
                            AND s.date = CAST(g.d AS DATE)""",
)
def eda_missing_dates_by_series(spark, sf_dir):
    """A7 per series: gaps inside each series' own date range."""
    return eda.missing_dates(_sales(spark, sf_dir), by=["business_type", "item_name"])


def _hist_sql(col: str) -> str:
    return S + f""", r AS (
        SELECT business_type,
               CASE WHEN min({col}) = max({col}) THEN min({col}) - 0.5 ELSE min({col}) END::DOUBLE AS lo,
               CASE WHEN min({col}) = max({col}) THEN max({col}) + 0.5 ELSE max({col}) END::DOUBLE AS hi
        FROM sales GROUP BY 1),
      c AS (
        SELECT s.business_type,
               CAST(least(floor(30.0 * (CAST(s.{col} AS DOUBLE) - r.lo) / (r.hi - r.lo)) + 1, 30) AS INTEGER) AS bin,
               count(*) AS n
        FROM sales s JOIN r USING (business_type) WHERE s.{col} IS NOT NULL GROUP BY 1, 2),
      g AS (SELECT business_type, lo, hi, unnest(range(1, 31)) AS bin FROM r)
      SELECT g.business_type, CAST(g.bin AS INTEGER) AS bin,
             g.lo + (g.bin - 1) * ((g.hi - g.lo) / 30) AS lower, g.lo + g.bin * ((g.hi - g.lo) / 30) AS upper,
             coalesce(c.n, 0) AS n
      FROM g LEFT JOIN c ON g.business_type = c.business_type AND g.bin = c.bin"""


HIST_COLS = "business_type:s, bin:i, lower:d, upper:d, n:i"


@register("eda_histogram_demand", HIST_COLS, _hist_sql("customer_demand"))
def eda_histogram_demand(spark, sf_dir):
    """30-bin demand histogram per business."""
    return eda.histogram(_sales(spark, sf_dir), "customer_demand")


@register("eda_histogram_waste", HIST_COLS, _hist_sql("waste_quantity"))
def eda_histogram_waste(spark, sf_dir):
    """30-bin waste histogram per business."""
    return eda.histogram(_sales(spark, sf_dir), "waste_quantity")


@register("eda_mean_by_weekday", "business_type:s, day_of_week:i, mean_demand:d",
          S + "SELECT business_type, isodow(date) - 1 AS day_of_week, avg(customer_demand) AS mean_demand FROM sales GROUP BY 1, 2")
def eda_mean_by_weekday(spark, sf_dir):
    """Mean demand by weekday per business."""
    return eda.mean_by_weekday(_sales(spark, sf_dir))


@register(
    "eda_weather_impact",
    "business_type:s, weather_condition:s, mean_demand:d, std_demand:d, mean_waste:d",
    S + """SELECT business_type, weather_condition, round(avg(customer_demand), 2) AS mean_demand,
                  round(stddev_samp(customer_demand), 2) AS std_demand, round(avg(waste_quantity), 2) AS mean_waste
           FROM sales GROUP BY 1, 2""",
)
def eda_weather_impact(spark, sf_dir):
    """A10: demand and waste by weather per business."""
    return eda.weather_impact(_sales(spark, sf_dir))


@register(
    "eda_holiday_impact",
    "business_type:s, holiday_flag:i, mean_demand:d, mean_waste:d",
    S + """SELECT business_type, holiday_flag, round(avg(customer_demand), 2) AS mean_demand,
                  round(avg(waste_quantity), 2) AS mean_waste FROM sales GROUP BY 1, 2""",
)
def eda_holiday_impact(spark, sf_dir):
    """Demand and waste on holidays vs other days."""
    return eda.holiday_impact(_sales(spark, sf_dir))


@register(
    "eda_weekend_impact",
    "business_type:s, is_weekend:i, mean_demand:d",
    S + """SELECT business_type, CAST(isodow(date) - 1 >= 5 AS INTEGER) AS is_weekend,
                  round(avg(customer_demand), 2) AS mean_demand FROM sales GROUP BY 1, 2""",
)
def eda_weekend_impact(spark, sf_dir):
    """Weekend vs weekday mean demand."""
    return eda.weekend_impact(_sales(spark, sf_dir))


@register("eda_daily_totals", "business_type:s, date:t, total_demand:i",
          S + "SELECT business_type, date, sum(customer_demand) AS total_demand FROM sales GROUP BY 1, 2")
def eda_daily_totals(spark, sf_dir):
    """Daily demand total per business."""
    return eda.daily_totals(_sales(spark, sf_dir))


def _corr_sql() -> str:
    cols = eda.CORR_COLS
    parts = []
    for a in cols:
        for b in cols:
            x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
            both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            xa, yb = f"CASE WHEN {both} THEN {x} END", f"CASE WHEN {both} THEN {y} END"
            parts.append(
                f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
                f"covar_pop({xa}, {yb}) / nullif(stddev_pop({xa}) * stddev_pop({yb}), 0) AS r FROM sales"
            )
    return S + "\nUNION ALL\n".join(parts)


@register("eda_correlation", "col_a:s, col_b:s, r:d", _corr_sql())
def eda_correlation(spark, sf_dir):
    """6 x 6 Pearson correlation matrix, long form."""
    return eda.correlation(_sales(spark, sf_dir))


@register(
    "eda_waste_pct_by_item",
    "business_type:s, item_name:s, mean_waste_pct:d",
    S + """SELECT business_type, item_name,
                  round(avg(coalesce(CAST(waste_quantity AS DOUBLE) / nullif(CAST(quantity_available AS DOUBLE), 0) * 100.0, 0.0)), 2)
                    AS mean_waste_pct
           FROM sales GROUP BY 1, 2""",
)
def eda_waste_pct_by_item(spark, sf_dir):
    """Mean waste % per item."""
    return eda.waste_pct_by_item(_sales(spark, sf_dir))


@register(
    "eda_business_insights",
    "business_type:s, units_sold:i, revenue:d, waste_units:i, waste_value:d, n_days:i, waste_value_per_day:d",
    S + """SELECT business_type, sum(quantity_sold) AS units_sold, sum(quantity_sold * price) AS revenue,
                  sum(waste_quantity) AS waste_units, sum(waste_quantity * price) AS waste_value,
                  count(DISTINCT date) AS n_days,
                  sum(waste_quantity * price) / count(DISTINCT date) AS waste_value_per_day
           FROM sales GROUP BY 1""",
)
def eda_business_insights(spark, sf_dir):
    """Units, revenue, waste units and value, waste value per day."""
    return eda.business_insights(_sales(spark, sf_dir))


@register(
    "eda_range_summary",
    "business_type:s, n:i, mean:d, std:d, least:d, largest:d, q0:d, q1:d",
    with_sql(SALES_SQL) + f""",
part AS (SELECT business_type, CAST(customer_demand AS DOUBLE) AS v, CASE WHEN customer_demand > 0 THEN
           CAST(floor(ln(CAST(customer_demand AS DOUBLE)) / ln(CAST({ds.GROWTH} AS DOUBLE))) AS INTEGER) END AS bucket
         FROM sales WHERE date BETWEEN DATE '1994-03-05' AND DATE '1996-02-17'),
b AS (SELECT business_type, bucket, sum(count(*)) OVER (PARTITION BY business_type ORDER BY bucket NULLS FIRST) AS upto,
             sum(count(*)) OVER (PARTITION BY business_type) AS total FROM part GROUP BY 1, 2),
q AS (SELECT business_type, arg_min(coalesce(pow(CAST({ds.GROWTH} AS DOUBLE), bucket + 0.5), 0.0), upto) FILTER (WHERE upto >= ceil(total * 0.5)) AS q0,
             arg_min(coalesce(pow(CAST({ds.GROWTH} AS DOUBLE), bucket + 0.5), 0.0), upto) FILTER (WHERE upto >= ceil(total * 0.95)) AS q1
      FROM b GROUP BY 1)
SELECT business_type, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS least, max(v) AS largest,
       any_value(q0) AS q0, any_value(q1) AS q1
FROM part JOIN q USING (business_type) GROUP BY business_type""",
)
def eda_range_summary(spark, sf_dir):
    """A2 + A4 + A14 for a range of days, merged from stored daily states without reading the sales again."""
    folder = work_dir(spark, "daystates")
    ds.write_states(td.load_sales(spark, sf_dir), folder)
    return ds.range_summary(spark, folder, "1994-03-05", "1996-02-17")
