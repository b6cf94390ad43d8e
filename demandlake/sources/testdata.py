"""Derived inputs over the driver's tables.

No sales table ships with the test data, so a daily ``sales`` table is
derived from ``lineitem`` joined to ``part``. The same definition exists as
SQL text (``SALES_SQL``) for the DuckDB oracle; both must stay identical.

Scale notes: the scan reads 5 lineitem columns and 2 part columns with the
return-flag filter pushed to Parquet. ``part`` grows with the data, so it
is never hint-broadcast; the planner (and AQE at runtime, behind
``autoBroadcastJoinThreshold``) decides. The aggregation to one row per
(business, item, day) is a partial + final hash aggregate, so hot keys are
combined map-side before the shuffle.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.schema import BUSINESS_TYPES, KNOWN_ITEMS, SALES_SCHEMA
from demandlake.session import cut_lineage, work_dir

DEFAULT_SF_DIR = "/root/testdata/sf0.01"

# Return flag -> business type of the derived sales table (fixed mapping).
RETURNFLAG_BUSINESS = {"A": "Restaurant", "N": "Cafe", "R": "Bakery"}


# Names of derived items: known ones, ones with a guess keyword ("Steak" holds "tea"), others.
KEYWORD_NAMES = ["Steak", "Iced Tea", "Meat Pie", "Spring Roll", "Rye Bread", "Mango Juice"]
# Parts that share an item of the sales table: the number of series grows with part.
PARTS_PER_ITEM = 40


def item_names(n: Column, other: Column) -> Column:
    """Name of item number ``n``: an eighth known, an eighth with a keyword, else ``other``."""
    pick = lambda names: F.element_at(
        F.array(*[F.lit(x) for x in names]), (F.floor(n / 8) % len(names) + 1).cast("int"))
    number = n.cast("string")
    return (F.when(n % 8 == 0, pick(list(KNOWN_ITEMS)))
            .when(n % 8 == 1, F.concat_ws(" ", pick(KEYWORD_NAMES), number)).otherwise(other))


def item_names_sql(n: str, other: str) -> str:
    pick = lambda names: "([" + ", ".join(f"'{x}'" for x in names) + f"])[CAST(({n}) // 8 % {len(names)} + 1 AS INTEGER)]"
    return (f"CASE WHEN ({n}) % 8 = 0 THEN {pick(list(KNOWN_ITEMS))} "
            f"WHEN ({n}) % 8 = 1 THEN {pick(KEYWORD_NAMES)} || ' ' || CAST({n} AS VARCHAR) ELSE {other} END")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def sales_from_tables(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Daily sales per (business_type, item_name, date)."""
    flags = list(RETURNFLAG_BUSINESS)
    li = lineitem.where(F.col("l_returnflag").isin(flags)).select(
        "l_partkey", "l_quantity", "l_discount", "l_returnflag", "l_shipdate"
    )
    p = part.select("p_partkey")
    n = F.floor(F.col("p_partkey") / PARTS_PER_ITEM)
    item = item_names(n, F.concat_ws(" ", F.lit("Dish"), n.cast("string")))
    business = F.when(F.col("l_returnflag") == "A", "Restaurant")
    for flag, biz in list(RETURNFLAG_BUSINESS.items())[1:]:
        business = business.when(F.col("l_returnflag") == flag, biz)
    qty = F.col("l_quantity").cast("bigint")
    avail_units = qty * F.round((F.lit(1.05) - F.col("l_discount")) * 100).cast("bigint")
    daily = (
        li.join(p, li.l_partkey == p.p_partkey)
        .groupBy(
            business.alias("business_type"),
            item.alias("item_name"),
            F.to_date("l_shipdate").alias("date"),
        )
        .agg(
            F.sum(qty).alias("customer_demand"),
            F.sum(avail_units).alias("_avail_units"),
        )
    )
    avail = F.expr("_avail_units div 100")
    sold = F.least(F.col("customer_demand"), avail)
    name_len = F.length("item_name").cast("double")
    out = daily.select(
        "business_type",
        "item_name",
        "date",
        (name_len * 10.0).alias("price"),
        (name_len * 3.0).alias("shelf_life_hours"),
        avail.cast("bigint").alias("quantity_available"),
        sold.cast("bigint").alias("quantity_sold"),
        F.col("customer_demand").cast("bigint").alias("customer_demand"),
        F.greatest(avail - sold, F.lit(0)).cast("bigint").alias("waste_quantity"),
        F.when(F.dayofmonth("date") % 5 == 0, "Rainy").otherwise("Clear").alias("weather_condition"),
        F.when(F.dayofyear("date") % 20 == 0, 1).otherwise(0).cast("int").alias("holiday_flag"),
    )
    return out.select([F.col(f.name).cast(f.dataType) for f in SALES_SCHEMA.fields])


def load_sales(spark: SparkSession, sf_dir: str = DEFAULT_SF_DIR, materialize: bool = False) -> DataFrame:
    """The daily sales table. ``materialize=True`` checkpoints it into the
    shared checkpoint folder: used by jobs that read it more than once
    (several actions, or a scalar subquery such as a max-date cutoff, which
    cannot reuse the main plan's exchange), so lineitem is scanned once."""
    df = sales_from_tables(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"))
    if materialize:
        df = cut_lineage(df)
    return df


def menu_items(part: DataFrame) -> DataFrame:
    """Menu items over ``part``: names by ``item_names`` (else p_name), shelf life from p_size,
    price p_partkey % 60 + 5, business by p_partkey % 3. These exercise the
    unknown-item guess (P7)."""
    biz = F.element_at(F.array(*[F.lit(b) for b in BUSINESS_TYPES]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return part.select(
        F.col("p_partkey").alias("item_id"),
        biz.alias("business_type"),
        item_names(F.col("p_partkey"), F.col("p_name")).alias("item_name"),
        ((F.col("p_partkey") % 60) + 5).cast("double").alias("price"),
        F.col("p_size").cast("double").alias("shelf_life_hours"),
    )


def request_log(events: DataFrame) -> DataFrame:
    """Request log over ``events``: endpoint = event_type, status 500 for 'error',
    503 for everything in the fourth hour of the 13th day (an outage), 404 for every
    40th event, else 200; latency = value / 100 s, fallback when user_id % 7 = 0."""
    down = (F.dayofmonth("ts") == 13) & (F.hour("ts") == 4)
    return events.select(
        F.col("event_id"),
        F.col("ts"),
        F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).when(down, 503).when(F.col("event_id") % 40 == 0, 404)
        .otherwise(200).cast("int").alias("status"),
        (F.col("value") / 100.0).alias("latency_s"),
        (F.col("user_id") % 7 == 0).alias("fallback"),
    )


# ---------------------------------------------------------------------------
# SQL text of the same derivations, for the DuckDB oracle.
# ---------------------------------------------------------------------------

SALES_SQL = """
sales AS (
  SELECT business_type, item_name, date,
         CAST(length(item_name) * 10.0 AS DOUBLE) AS price,
         CAST(length(item_name) * 3.0 AS DOUBLE) AS shelf_life_hours,
         CAST(avail AS BIGINT) AS quantity_available,
         CAST(least(customer_demand, avail) AS BIGINT) AS quantity_sold,
         CAST(customer_demand AS BIGINT) AS customer_demand,
         CAST(greatest(avail - least(customer_demand, avail), 0) AS BIGINT) AS waste_quantity,
         CASE WHEN dayofmonth(date) % 5 = 0 THEN 'Rainy' ELSE 'Clear' END AS weather_condition,
         CAST(CASE WHEN dayofyear(date) % 20 = 0 THEN 1 ELSE 0 END AS INTEGER) AS holiday_flag
  FROM (
    SELECT CASE l_returnflag WHEN 'A' THEN 'Restaurant' WHEN 'N' THEN 'Cafe' WHEN 'R' THEN 'Bakery' END AS business_type,
           {item} AS item_name,
           CAST(l_shipdate AS DATE) AS date,
           CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS customer_demand,
           CAST(sum(CAST(l_quantity AS BIGINT) * CAST(round((1.05 - l_discount) * 100) AS BIGINT)) AS BIGINT) // 100 AS avail
    FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE l_returnflag IN ('A', 'N', 'R')
    GROUP BY 1, 2, 3
  ) d
)
""".replace("{item}", item_names_sql(f"(p_partkey // {PARTS_PER_ITEM})",
                                     f"'Dish ' || CAST(p_partkey // {PARTS_PER_ITEM} AS VARCHAR)"))

MENU_SQL = """
menu AS (
  SELECT p_partkey AS item_id,
         (['Restaurant', 'Cafe', 'Bakery'])[CAST(p_partkey % 3 + 1 AS INTEGER)] AS business_type,
         {item} AS item_name,
         CAST(p_partkey % 60 + 5 AS DOUBLE) AS price,
         CAST(p_size AS DOUBLE) AS shelf_life_hours
  FROM part
)
""".replace("{item}", item_names_sql("p_partkey", "p_name"))

REQUEST_LOG_SQL = """
reqlog AS (
  SELECT event_id, ts, event_type AS endpoint,
         CAST(CASE WHEN event_type = 'error' THEN 500 WHEN day(ts) = 13 AND hour(ts) = 4 THEN 503
                   WHEN event_id % 40 = 0 THEN 404 ELSE 200 END AS INTEGER) AS status,
         value / 100.0 AS latency_s,
         (user_id % 7 = 0) AS fallback
  FROM events
)
"""


def with_sql(*ctes: str) -> str:
    """``WITH`` prefix joining the given CTE texts."""
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


# ---------------------------------------------------------------------------
# Further derived inputs: forecast/actual pairs, plans, accuracy log,
# uploads and forecast requests. All grow with the underlying tables.
# ---------------------------------------------------------------------------


def raw_sales(sales: DataFrame) -> DataFrame:
    """The sales table as an export would hold it: text columns, with bad cells on
    certain days of the year (an unreadable date, no demand, negative or
    excessive sales, wrong waste, bad price, shelf life, weather and flag, a
    quantity that is not whole, negative availability)."""
    day = F.dayofyear("date") % 50
    bad = {
        "date": [(1, F.lit("2024-13-45"))],
        "customer_demand": [(2, F.lit(None).cast("string"))],
        "quantity_sold": [(3, (-F.col("quantity_sold") - 1).cast("string")),
                          (4, (F.col("quantity_available") + 5).cast("string"))],
        "waste_quantity": [(5, (F.col("waste_quantity") + 1).cast("string")), (12, F.lit("-2"))],
        "price": [(6, F.lit("0"))],
        "shelf_life_hours": [(7, F.lit("-1"))],
        "weather_condition": [(8, F.lit("Snowy"))],
        "holiday_flag": [(9, F.lit("2"))],
        "quantity_available": [(10, F.lit("12.7")), (11, F.lit("-4"))],
    }
    out = []
    for f in SALES_SCHEMA.fields:
        e = F.col(f.name).cast("string")
        for k, v in bad.get(f.name, []):
            e = F.when(day == k, v).otherwise(e)
        out.append(e.alias(f.name))
    return sales.select(*out)


RAW_SALES_SQL = """
raw AS (
  SELECT business_type, item_name,
         CASE WHEN k = 1 THEN '2024-13-45' ELSE CAST(date AS VARCHAR) END AS date,
         CASE WHEN k = 6 THEN '0' ELSE CAST(price AS VARCHAR) END AS price,
         CASE WHEN k = 7 THEN '-1' ELSE CAST(shelf_life_hours AS VARCHAR) END AS shelf_life_hours,
         CASE WHEN k = 10 THEN '12.7' WHEN k = 11 THEN '-4' ELSE CAST(quantity_available AS VARCHAR) END AS quantity_available,
         CASE WHEN k = 3 THEN CAST(-quantity_sold - 1 AS VARCHAR) WHEN k = 4 THEN CAST(quantity_available + 5 AS VARCHAR)
              ELSE CAST(quantity_sold AS VARCHAR) END AS quantity_sold,
         CASE WHEN k = 2 THEN NULL ELSE CAST(customer_demand AS VARCHAR) END AS customer_demand,
         CASE WHEN k = 5 THEN CAST(waste_quantity + 1 AS VARCHAR) WHEN k = 12 THEN '-2'
              ELSE CAST(waste_quantity AS VARCHAR) END AS waste_quantity,
         CASE WHEN k = 8 THEN 'Snowy' ELSE weather_condition END AS weather_condition,
         CASE WHEN k = 9 THEN '2' ELSE CAST(holiday_flag AS VARCHAR) END AS holiday_flag
  FROM (SELECT *, dayofyear(date) % 50 AS k FROM sales) s
),
dirty AS (
  SELECT business_type, item_name, CAST(try_strptime(date, '%Y-%m-%d') AS DATE) AS date, TRY_CAST(price AS DOUBLE) AS price,
         TRY_CAST(shelf_life_hours AS DOUBLE) AS shelf_life_hours,
         {available} AS quantity_available, {sold} AS quantity_sold, {demand} AS customer_demand, {waste} AS waste_quantity,
         weather_condition, {holiday} AS holiday_flag,
         date IS NOT NULL AND try_strptime(date, '%Y-%m-%d') IS NULL AS bad_date,
         quantity_available IS NOT NULL AND {available} IS NULL AS bad_cell
  FROM raw
)
"""
for _name, _col in (("available", "quantity_available"), ("sold", "quantity_sold"), ("demand", "customer_demand"),
                    ("waste", "waste_quantity"), ("holiday", "holiday_flag")):
    RAW_SALES_SQL = RAW_SALES_SQL.replace("{%s}" % _name, (
        f"CASE WHEN TRY_CAST({_col} AS DOUBLE) = floor(TRY_CAST({_col} AS DOUBLE)) "
        f"THEN CAST(TRY_CAST({_col} AS DOUBLE) AS BIGINT) END"))


#: rows of the series windows that one task holds, however large the table
SERIES_TASK_ROWS = 500_000


def series_parts(spark: SparkSession, sf_dir: str) -> int:
    """Number of tasks for the series windows: lineitem has at least as many rows as the sales table, and its
    number of rows is read from the footers of its files."""
    return -(-table(spark, sf_dir, "lineitem").count() // SERIES_TASK_ROWS)


def naive_pairs(sales: DataFrame, complete: bool = True, parts: int | None = None) -> DataFrame:
    """Actual vs a naive forecast (demand 7 rows earlier in the series), so
    the accuracy operators can be checked without a model. The first rows of a
    series have no forecast; ``complete=False`` keeps them. ``parts`` (``series_parts``) deals the series
    over so many tasks if the session's number of shuffle partitions is less."""
    from pyspark.sql import Window

    if parts and parts > int(sales.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        sales = sales.select("business_type", "item_name", "date", "customer_demand", "quantity_available").repartition(
            parts, "business_type", "item_name")
    w = Window.partitionBy("business_type", "item_name").orderBy("date")
    return (
        sales.select("business_type", "item_name", "date",
                     F.col("customer_demand").cast("double").alias("y_true"),
                     F.lag("customer_demand", 7).over(w).cast("double").alias("y_pred"),
                     F.col("quantity_available"))
        .where(F.col("y_pred").isNotNull() if complete else F.lit(True))
    )


def plans(sales: DataFrame) -> DataFrame:
    """Production plans: the quantity actually made (quantity_available)
    against the naive forecast of the day."""
    return naive_pairs(sales).select(
        "business_type", "item_name", "date",
        F.col("y_pred").cast("bigint").alias("predicted_demand"),
        F.col("quantity_available").cast("bigint").alias("planned_quantity"),
    )


def accuracy_log(sales: DataFrame, parts: int | None = None) -> DataFrame:
    """Accuracy log: one entry per (series, week) of naive-forecast scores; ``parts`` as in ``naive_pairs``."""
    from demandlake.operators.monitor import score_actuals

    return score_actuals(naive_pairs(sales, parts=parts), ts="date")


def uploads(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """An uploaded sales file (text date) over lineitem rows, with the bad
    cells real uploads have: unparseable dates (line number 7), no name (6), negative
    sales (quantity below 3) and sales above availability."""
    li = lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate")
    j = li.join(part.select("p_partkey", "p_type"), li.l_partkey == part.p_partkey)
    return j.select(
        F.when(F.col("l_linenumber") == 7, F.lit("2024-13-45"))
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date"),
        F.when(F.col("l_linenumber") != 6, F.col("p_type")).alias("item_name"),
        (F.col("l_quantity").cast("bigint") - 3).alias("quantity_sold"),
        (F.col("l_quantity").cast("bigint") + F.col("l_orderkey") % 5 - 4).alias("quantity_available"),
    )


def week_requests(part: DataFrame) -> DataFrame:
    """Week forecast requests over ``part``, including the invalid inputs
    the validators reject: blank names (size 1), unknown business (2), bad
    date (3), 6 weather days (4), unknown weather (5), holiday flag 2 (6),
    non-positive price (p_partkey % 60 below 3)."""
    size = F.col("p_size")
    biz = F.element_at(F.array(*[F.lit(b) for b in BUSINESS_TYPES]), (F.col("p_partkey") % 3 + 1).cast("int"))
    days = F.sequence(F.lit(0), F.lit(6))
    weather = F.transform(days, lambda i: F.when((F.col("p_partkey") + i) % 5 == 0, F.lit("Rainy")).otherwise(F.lit("Clear")))
    holidays = F.transform(days, lambda i: F.when((F.col("p_partkey") + i) % 20 == 0, F.lit(1)).otherwise(F.lit(0)))
    return part.select(
        F.col("p_partkey").alias("request_id"),
        F.when(size == 1, F.lit("   ")).otherwise(item_names(F.col("p_partkey"), F.col("p_name"))).alias("item_name"),
        F.when(size == 2, F.lit("Diner")).otherwise(biz).alias("business_type"),
        ((F.col("p_partkey") % 60) - 2).cast("double").alias("price"),
        (size / 2.0).alias("shelf_life_hours"),
        F.when(size == 3, F.lit("2025-13-01"))
        .otherwise(F.date_format(F.date_add(F.lit("2025-12-01").cast("date"), size), "yyyy-MM-dd"))
        .alias("starting_date"),
        F.when(size == 4, F.slice(weather, 1, 6))
        .when(size == 5, F.concat(F.slice(weather, 1, 6), F.array(F.lit("Snowy"))))
        .otherwise(weather).alias("weather_forecast"),
        F.when(size == 6, F.concat(F.slice(holidays, 1, 6), F.array(F.lit(2))))
        .otherwise(holidays).cast("array<int>").alias("holiday_flags"),
    )


def day_requests(part: DataFrame) -> DataFrame:
    """Single-day requests over ``part``: the week request's start date
    with the weather and holiday flag of its last listed day (so the
    unknown-weather and holiday-2 cases carry over)."""
    w = week_requests(part)
    return w.select(
        "request_id", "item_name", "business_type", "price", "shelf_life_hours",
        F.col("starting_date").alias("date"),
        F.element_at("weather_forecast", -1).alias("weather"),
        F.element_at("holiday_flags", -1).alias("is_holiday"),
    )


DAY_REQUESTS_SQL = """
day_requests AS (
  SELECT request_id, item_name, business_type, price, shelf_life_hours, starting_date AS date,
         weather_forecast[-1] AS weather, holiday_flags[-1] AS is_holiday
  FROM requests
)
"""

NAIVE_SQL = """
naive_all AS (
    SELECT business_type, item_name, date, CAST(customer_demand AS DOUBLE) AS y_true,
           CAST(lag(customer_demand, 7) OVER (PARTITION BY business_type, item_name ORDER BY date) AS DOUBLE) AS y_pred,
           quantity_available
    FROM sales
),
naive AS (SELECT * FROM naive_all WHERE y_pred IS NOT NULL)
"""

PLANS_SQL = """
plans AS (
  SELECT business_type, item_name, date, CAST(y_pred AS BIGINT) AS predicted_demand,
         CAST(quantity_available AS BIGINT) AS planned_quantity
  FROM naive
)
"""

ACCURACY_LOG_SQL = """
acclog AS (
  SELECT business_type, item_name, timestamp, round(mae, 2) AS mae, round(mape, 2) AS mape,
         round(rmse, 2) AS rmse, CAST(round(CAST(r2 AS DECIMAL(38, 9)), 3) AS DOUBLE) AS r2, n_predictions, round(mape, 2) > 25 AS drift
  FROM (
    SELECT business_type, item_name, CAST(date_trunc('week', date) AS TIMESTAMP) AS timestamp,
           avg(abs(y_true - y_pred)) AS mae,
           avg(abs(y_true - y_pred) / greatest(abs(y_true), 2.220446049250313e-16)) * 100.0 AS mape,
           sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse,
           CASE WHEN var_pop(y_true) * count(y_true) = 0
                THEN CASE WHEN sum((y_true - y_pred) * (y_true - y_pred)) = 0 THEN 1.0 ELSE 0.0 END
                ELSE 1.0 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(y_true)) END AS r2,
           count(y_true) AS n_predictions
    FROM naive GROUP BY 1, 2, 3) s
)
"""

UPLOADS_SQL = """
uploads AS (
  SELECT CASE WHEN l_linenumber = 7 THEN '2024-13-45' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date,
         CASE WHEN l_linenumber <> 6 THEN p_type END AS item_name,
         CAST(l_quantity AS BIGINT) - 3 AS quantity_sold,
         CAST(l_quantity AS BIGINT) + l_orderkey % 5 - 4 AS quantity_available
  FROM lineitem JOIN part ON l_partkey = p_partkey
)
"""

REQUESTS_SQL = """
requests AS (
  SELECT p_partkey AS request_id,
         CASE WHEN p_size = 1 THEN '   ' ELSE {item} END AS item_name,
         CASE WHEN p_size = 2 THEN 'Diner' ELSE (['Restaurant', 'Cafe', 'Bakery'])[CAST(p_partkey % 3 + 1 AS INTEGER)] END AS business_type,
         CAST(p_partkey % 60 - 2 AS DOUBLE) AS price,
         p_size / 2.0 AS shelf_life_hours,
         CASE WHEN p_size = 3 THEN '2025-13-01' ELSE strftime(DATE '2025-12-01' + CAST(p_size AS INTEGER), '%Y-%m-%d') END AS starting_date,
         CASE WHEN p_size = 4 THEN w[1:6] WHEN p_size = 5 THEN list_concat(w[1:6], ['Snowy']) ELSE w END AS weather_forecast,
         CASE WHEN p_size = 6 THEN list_concat(h[1:6], [2]) ELSE h END AS holiday_flags
  FROM (SELECT *,
               [CASE WHEN (p_partkey + i) % 5 = 0 THEN 'Rainy' ELSE 'Clear' END FOR i IN range(0, 7)] AS w,
               [CASE WHEN (p_partkey + i) % 20 = 0 THEN 1 ELSE 0 END FOR i IN range(0, 7)] AS h
        FROM part) p
)
""".replace("{item}", item_names_sql("p_partkey", "p_name"))


def series_requests(sales: DataFrame) -> DataFrame:
    """One week-forecast request per sales series, starting the day after
    the series' last sales date, with weather and holidays from the same
    calendar rules as the sales table."""
    days = F.sequence(F.lit(0), F.lit(6))
    start = F.date_add(F.col("_last"), 1)
    weather = F.transform(days, lambda i: F.when(F.dayofmonth(F.date_add(F.col("_last"), i + 1)) % 5 == 0,
                                                 F.lit("Rainy")).otherwise(F.lit("Clear")))
    holidays = F.transform(days, lambda i: F.when(F.dayofyear(F.date_add(F.col("_last"), i + 1)) % 20 == 0,
                                                  F.lit(1)).otherwise(F.lit(0)))
    return sales.groupBy("business_type", "item_name").agg(
        F.max("date").alias("_last"),
        F.max_by("price", "date").alias("price"),
        F.max_by("shelf_life_hours", "date").alias("shelf_life_hours"),
    ).select(
        F.substring(F.md5(F.concat_ws("|", "business_type", "item_name")), 1, 16).alias("request_id"),
        "item_name", "business_type", "price", "shelf_life_hours",
        F.date_format(start, "yyyy-MM-dd").alias("starting_date"),
        weather.alias("weather_forecast"),
        holidays.cast("array<int>").alias("holiday_flags"),
    )


def all_requests(spark, sf_dir: str, sales: DataFrame | None = None) -> DataFrame:
    """Valid week requests: every sales series plus every menu request
    that passes validation (request ids as text)."""
    from demandlake.operators.quality import validate_requests

    sales = sales if sales is not None else load_sales(spark, sf_dir)
    ok, _ = validate_requests(week_requests(table(spark, sf_dir, "part")))
    return series_requests(sales).unionByName(ok.withColumn("request_id", F.col("request_id").cast("string")))


SERIES_REQUESTS_SQL = """
series_req AS (
  SELECT request_id, item_name, business_type, price, shelf_life_hours,
         strftime(last + 1, '%Y-%m-%d') AS starting_date,
         [CASE WHEN dayofmonth(last + 1 + CAST(i AS INTEGER)) % 5 = 0 THEN 'Rainy' ELSE 'Clear' END FOR i IN range(0, 7)]
           AS weather_forecast,
         [CASE WHEN dayofyear(last + 1 + CAST(i AS INTEGER)) % 20 = 0 THEN 1 ELSE 0 END FOR i IN range(0, 7)] AS holiday_flags
  FROM (SELECT substr(md5(business_type || '|' || item_name), 1, 16) AS request_id, item_name, business_type,
               arg_max(price, date) AS price, arg_max(shelf_life_hours, date) AS shelf_life_hours, max(date) AS last
        FROM sales GROUP BY business_type, item_name) s
)
"""

VALID_REQUESTS_SQL = """
valid_req AS (
  SELECT CAST(request_id AS VARCHAR) AS request_id, trim(item_name) AS item_name, business_type, price,
         shelf_life_hours, starting_date, weather_forecast, holiday_flags
  FROM requests
  WHERE coalesce(length(trim(item_name)) > 0, false)
    AND coalesce(business_type IN ('Restaurant', 'Cafe', 'Bakery'), false)
    AND coalesce(price > 0, false) AND coalesce(shelf_life_hours > 0, false)
    AND try_strptime(trim(starting_date), '%Y-%m-%d') IS NOT NULL
    AND coalesce(len(weather_forecast) = 7, false)
    AND coalesce(list_bool_and(list_transform(weather_forecast, lambda x: coalesce(x IN ('Clear', 'Rainy'), false))), false)
    AND coalesce(len(holiday_flags) = 7, false)
    AND coalesce(list_bool_and(list_transform(holiday_flags, lambda x: coalesce(x IN (0, 1), false))), false)
),
all_req AS (SELECT * FROM series_req UNION ALL SELECT * FROM valid_req)
"""


# ---------------------------------------------------------------------------
# CSV uploads in three layouts, with malformed lines.
# ---------------------------------------------------------------------------

#: layout -> (business type, columns of its files in order); ``note`` is a column nobody asks for
UPLOAD_LAYOUTS = {
    "restaurant": ("Restaurant", ["holiday_flag", "weather_condition", "note", "waste_quantity", "customer_demand",
                                  "quantity_sold", "quantity_available", "shelf_life_hours", "price", "date", "item_name",
                                  "business_type"]),
    "cafe": ("Cafe", [f.name for f in SALES_SCHEMA.fields]),
    "bakery": ("Bakery", ["item_name", "date", "quantity_sold", "quantity_available", "price", "business_type",
                          "customer_demand", "waste_quantity", "shelf_life_hours", "weather_condition"]),
}
#: day of the year modulo 50 -> a line with a cell too many, cut after two cells, with a quote left open
LONG_LINE, SHORT_LINE, OPEN_LINE = 0, 25, 10
_WHOLE = ("price", "shelf_life_hours")


def upload_lines(sales: DataFrame) -> DataFrame:
    """(layout, line): the sales table as CSV lines of ``UPLOAD_LAYOUTS``."""
    day = F.dayofyear("date") % 50
    named = sales.withColumn("note", F.concat(F.lit("day "), day.cast("string"))).withColumn(
        "item_name", F.when(day == OPEN_LINE, F.concat(F.lit('"'), "item_name")).otherwise(F.col("item_name")))
    layout = line = F.lit(None).cast("string")
    for name, (business, cols) in UPLOAD_LAYOUTS.items():
        cells = [(F.col(c).cast("bigint") if c in _WHOLE else F.col(c)).cast("string") for c in cols]
        full = F.concat_ws(",", *cells)
        own = F.when(day == LONG_LINE, F.concat(full, F.lit(",extra"))).when(
            day == SHORT_LINE, F.concat_ws(",", *cells[:2])).otherwise(full)
        mine = F.col("business_type") == business
        layout, line = F.when(mine, name).otherwise(layout), F.when(mine, own).otherwise(line)
    return named.select(layout.alias("layout"), line.alias("line"))


def write_uploads(sales: DataFrame, base: str) -> list[str]:
    """Writes the lines under ``base``/layout=<name>, each file with its layout's header. The lines are
    made once for all layouts."""
    made = work_dir(sales.sparkSession, "lines")
    upload_lines(sales).write.partitionBy("layout").parquet(made)
    lines = sales.sparkSession.read.schema("line string, layout string").parquet(made)
    paths = []
    for name, (_, cols) in UPLOAD_LAYOUTS.items():
        paths.append(f"{base}/layout={name}")
        # one column whose name is the header and whose values are whole lines: nothing is quoted
        lines.where(F.col("layout") == name).select(F.col("line").alias(",".join(cols))).write.option("header", True).option(
            "sep", "\u0001").option("quote", "\u0002").csv(paths[-1])
    return paths


def _upload_line_sql(cols: list[str]) -> str:
    cells = []
    for c in cols:
        e = {"note": "'day ' || CAST(k AS VARCHAR)",
             "item_name": f"CASE WHEN k = {OPEN_LINE} THEN '\"' || item_name ELSE item_name END"}.get(c, c)
        cells.append(f"CAST(CAST({e} AS BIGINT) AS VARCHAR)" if c in _WHOLE else f"CAST({e} AS VARCHAR)")
    full = f"concat_ws(',', {', '.join(cells)})"
    return (f"CASE k WHEN {LONG_LINE} THEN {full} || ',extra' "
            f"WHEN {SHORT_LINE} THEN concat_ws(',', {cells[0]}, {cells[1]}) ELSE {full} END")


UPLOAD_LINES_SQL = f"""
keyed AS (SELECT *, dayofyear(date) % 50 AS k FROM sales),
upload_lines AS (
  SELECT k, CASE business_type {' '.join(f"WHEN '{b}' THEN '{n}'" for n, (b, _) in UPLOAD_LAYOUTS.items())} END AS layout,
         CASE business_type {' '.join(f"WHEN '{b}' THEN {_upload_line_sql(c)}" for b, c in UPLOAD_LAYOUTS.values())} END AS line,
         CASE business_type {' '.join(f"WHEN '{b}' THEN {len(c)}" for b, c in UPLOAD_LAYOUTS.values())} END AS width
  FROM keyed),
by_name AS (
  SELECT business_type, item_name, date, price, shelf_life_hours, quantity_available, quantity_sold, customer_demand,
         waste_quantity, weather_condition, CASE WHEN business_type <> 'Bakery' THEN holiday_flag END AS holiday_flag
  FROM keyed WHERE k NOT IN ({LONG_LINE}, {SHORT_LINE}, {OPEN_LINE}))
"""
