"""Registered queries: the derived sales table and features (S1/S7, P*, W*, F*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlake.functions.items import item_features
from demandlake.operators import features as fe
from demandlake.operators import windows as wn
from demandlake.operators.splitwindows import split_windows
from demandlake.plans.registry import register
from demandlake.plans.sqltext import (
    business_code_sql,
    calendar_sql,
    category_code_sql,
    cyclical_sql,
    features_sql,
    interactions_sql,
    item_sql,
    rainy_sql,
    windows_sql,
)
from demandlake.schema import FEATURE_COLS
from demandlake.sources import testdata as td
from demandlake.sources.testdata import MENU_SQL, SALES_SQL, with_sql

KEYS = "business_type:s, item_name:s, date:t"
SALES_COLS = (
    f"{KEYS}, price:d, shelf_life_hours:d, quantity_available:i, quantity_sold:i, "
    "customer_demand:i, waste_quantity:i, weather_condition:s, holiday_flag:i"
)


@register("sales_daily", SALES_COLS, with_sql(SALES_SQL) + "SELECT * FROM sales")
def sales_daily(spark, sf_dir):
    """Daily sales table derived from lineitem x part (the input of every
    demand operator)."""
    return td.load_sales(spark, sf_dir)


@register(
    "sales_overview",
    "min_date:t, max_date:t, n_rows:i, n_series:i, business_types:s",
    with_sql(SALES_SQL)
    + """SELECT min(date) AS min_date, max(date) AS max_date, count(*) AS n_rows,
              count(DISTINCT (business_type, item_name)) AS n_series,
              array_to_string(list_sort(list(DISTINCT business_type)), ',') AS business_types
         FROM sales""",
)
def sales_overview(spark, sf_dir):
    """Date range, row count, series count, sorted business types."""
    from demandlake.sources.sales import overview

    return overview(td.load_sales(spark, sf_dir))


CAL_COLS = (
    f"{KEYS}, day_of_week:i, day_name:s, month:i, week_of_year:i, day_of_month:i, is_weekend:i, "
    "is_monday:i, is_friday:i, is_saturday:i, is_sunday:i, is_rainy:i, day_sin:d, day_cos:d, "
    "month_sin:d, month_cos:d, weekend_x_holiday:i, rainy_x_weekend:i, rainy_x_holiday:i, friday_x_weekend:i"
)


@register(
    "features_calendar",
    CAL_COLS,
    with_sql(SALES_SQL)
    + f"""SELECT *, {interactions_sql()}, {cyclical_sql()} FROM (
            SELECT business_type, item_name, date, holiday_flag, {calendar_sql()}, {rainy_sql()} AS is_rainy
            FROM sales) c""",
)
def features_calendar(spark, sf_dir):
    """Calendar, day flags, rain flag, cyclical and interaction columns."""
    df = td.load_sales(spark, sf_dir)
    df = fe.add_interactions(fe.add_weather(fe.add_calendar(df)))
    return fe.add_cyclical(df)


_cat_kw, _cx_kw = item_sql()
_cat_nk, _cx_nk = item_sql(keywords=False)


@register(
    "features_items",
    "item_id:i, business_type:s, item_name:s, category:s, preparation_complexity:i, "
    "category_encoded:i, business_encoded:i, category_no_keywords:s, complexity_no_keywords:i",
    with_sql(MENU_SQL)
    + f"""SELECT item_id, business_type, item_name, category, preparation_complexity,
              {category_code_sql()} AS category_encoded, {business_code_sql()} AS business_encoded,
              category_no_keywords, complexity_no_keywords
         FROM (SELECT *, {_cat_kw} AS category, {_cx_kw} AS preparation_complexity,
                      {_cat_nk} AS category_no_keywords, {_cx_nk} AS complexity_no_keywords
               FROM menu) m""",
)
def features_items(spark, sf_dir):
    """P6-P8 over menu items derived from ``part`` (known names, names with a
    keyword and others), with and without the keyword stage (P7b)."""
    menu = td.menu_items(td.table(spark, sf_dir, "part"))
    df = fe.encode_labels(fe.enrich_items(menu))
    cat, cx = item_features("item_name", "price", "shelf_life_hours", keywords=False)
    return df.withColumns({"category_no_keywords": cat, "complexity_no_keywords": cx})


WIN_COLS = (
    f"{KEYS}, prev_day_demand:d, prev_day_sold:d, prev_day_waste:d, prev_week_demand:d, "
    "rolling_3day_demand:d, rolling_7day_demand:d, rolling_14day_demand:d, rolling_30day_demand:d, "
    "rolling_7day_std:d, rolling_14day_std:d"
)


@register(
    "features_windows",
    WIN_COLS,
    with_sql(SALES_SQL) + f"SELECT business_type, item_name, date, {windows_sql(True)} FROM sales",
)
def features_windows(spark, sf_dir):
    """Lags and rolling stats per series, current row included (as
    in training); nulls kept."""
    return fe.add_rolling(fe.add_lags(td.load_sales(spark, sf_dir)))


@register(
    "features_windows_past_only",
    WIN_COLS,
    with_sql(SALES_SQL) + f"SELECT business_type, item_name, date, {windows_sql(False)} FROM sales",
)
def features_windows_past_only(spark, sf_dir):
    """W3/W4 with ``include_current=False``: frames end at the previous row
    (no label leakage)."""
    return fe.add_rolling(fe.add_lags(td.load_sales(spark, sf_dir)), include_current=False)


@register(
    "features_windows_split",
    WIN_COLS,
    with_sql(SALES_SQL) + f"SELECT business_type, item_name, date, {windows_sql(True)} FROM sales",
)
def features_windows_split(spark, sf_dir):
    """W1-W4 over ranges with a halo instead of whole series, as for series too large for a task."""
    def columns(keys, order):
        return {**fe.lag_columns(keys, order), **fe.rolling_columns(keys=keys, order=order)}

    return split_windows(td.load_sales(spark, sf_dir), columns, ["date"], n_ranges=61)


FULL_COLS = KEYS + ", " + ", ".join(
    f"{c}:{'d' if c in ('day_sin', 'day_cos', 'month_sin', 'month_cos', 'price', 'shelf_life_hours') or c.startswith(('prev_', 'rolling_')) else 'i'}"
    for c in FEATURE_COLS
) + ", customer_demand:i"


@register(
    "features_windows_by_day",
    WIN_COLS,
    with_sql(SALES_SQL) + f""", cal AS (
  SELECT business_type, item_name, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
  FROM sales GROUP BY 1, 2),
dense AS (
  SELECT c.business_type, c.item_name, c.date, s.customer_demand, s.quantity_sold, s.waste_quantity,
         s.business_type IS NULL AS filled
  FROM cal c LEFT JOIN sales s
    ON c.business_type = s.business_type AND c.item_name = s.item_name AND c.date = s.date)
SELECT business_type, item_name, date, prev_day_demand, prev_day_sold, prev_day_waste, prev_week_demand,
       rolling_3day_demand, rolling_7day_demand, rolling_14day_demand, rolling_30day_demand,
       rolling_7day_std, rolling_14day_std
FROM (SELECT business_type, item_name, date, filled, {windows_sql(True)} FROM dense) w
WHERE NOT filled""",
)
def features_windows_by_day(spark, sf_dir):
    """W1-W4 over the densified calendar: gap days count, so the previous
    week is 7 days back (SURVEY hard part 5, ``densify_days=True``)."""
    df = fe.densify(td.load_sales(spark, sf_dir))
    df = fe.add_rolling(fe.add_lags(df))
    return df.where(~F.col(fe.FILLED))


@register(
    "features_full",
    FULL_COLS,
    with_sql(SALES_SQL, features_sql()) + "SELECT * FROM feats",
)
def features_full(spark, sf_dir):
    """P1-P13 + W1-W4: the ordered 34-column model input plus the label,
    numeric nulls filled with 0."""
    return fe.build_features(td.load_sales(spark, sf_dir))


@register(
    "money_and_waste",
    f"{KEYS}, revenue:d, waste_value:d, waste_pct:d, quantity_sold:i, waste_quantity:i",
    with_sql(SALES_SQL)
    + """SELECT business_type, item_name, date,
              quantity_sold * price AS revenue, waste_quantity * price AS waste_value,
              coalesce(CAST(waste_quantity AS DOUBLE) / nullif(CAST(quantity_available AS DOUBLE), 0) * 100.0, 0.0) AS waste_pct,
              quantity_sold, waste_quantity
         FROM sales""",
)
def money_and_waste(spark, sf_dir):
    """sold/waste rule re-derived from demand and availability,
    revenue, waste value, waste %."""
    df = td.load_sales(spark, sf_dir)
    df = fe.derive_sold_waste(df.drop("quantity_sold", "waste_quantity"))
    return fe.add_waste_pct(fe.add_money(df))


@register(
    "history_last_30",
    f"{KEYS}, customer_demand:i, rank_from_end:i",
    with_sql(SALES_SQL)
    + """SELECT * FROM (
           SELECT business_type, item_name, date, customer_demand,
                  row_number() OVER (PARTITION BY business_type, item_name ORDER BY date DESC) AS rank_from_end
           FROM sales) r WHERE rank_from_end <= 30""",
)
def history_last_30(spark, sf_dir):
    """The last 30 rows of every series."""
    return wn.last_n(td.load_sales(spark, sf_dir), ["business_type", "item_name"], "date", 30,
                     rank_col="rank_from_end").select("business_type", "item_name", "date", "customer_demand",
                                                      "rank_from_end")


@register(
    "time_split_summary",
    "part:s, n_rows:i, min_date:t, max_date:t, sum_demand:i",
    with_sql(SALES_SQL)
    + """, c AS (SELECT max(date) - INTERVAL 30 DAY AS cutoff FROM sales)
         SELECT CASE WHEN date <= CAST(cutoff AS DATE) THEN 'train' ELSE 'test' END AS part,
                count(*) AS n_rows, min(date) AS min_date, max(date) AS max_date, sum(customer_demand) AS sum_demand
         FROM sales, c GROUP BY 1""",
)
def time_split_summary(spark, sf_dir):
    """cutoff = max(date) - 30 days; train <= cutoff < test."""
    train, test = wn.time_split(td.load_sales(spark, sf_dir, materialize=True), days=30)

    def summary(df, name):
        return df.groupBy(F.lit(name).alias("part")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("min_date"),
            F.max("date").alias("max_date"), F.sum("customer_demand").alias("sum_demand"))

    return summary(train, "train").unionByName(summary(test, "test"))


@register(
    "filter_one_series",
    SALES_COLS,
    with_sql(SALES_SQL) + "SELECT * FROM sales WHERE business_type = 'Cafe' AND item_name = 'Dish 2'",
)
def filter_one_series(spark, sf_dir):
    """equality filters on business and item."""
    return wn.filter_series(td.load_sales(spark, sf_dir), business_type="Cafe", item_name="Dish 2")
