"""Registered queries: the recursive forecaster (H1-H11, C1) with a fixed linear
model, so that SQL can restate every step: seven CTE pairs (features, then the
rounded prediction) feed each other as the scoring loop does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlake.plans import forecast as fc
from demandlake.plans.registry import register
from demandlake.plans.sqltext import business_code_sql, category_code_sql, item_sql
from demandlake.schema import FEATURE_COLS, HORIZON_DAYS, KNOWN_ITEMS
from demandlake.sources import testdata as td
from demandlake.sources.testdata import (
    MENU_SQL,
    REQUESTS_SQL,
    SALES_SQL,
    SERIES_REQUESTS_SQL,
    VALID_REQUESTS_SQL,
    with_sql,
)

INTERCEPT = 3.1873
COEFFICIENTS = dict(zip(FEATURE_COLS, [
    0.1137, 0.0213, 0.0131, 0.0177, 1.3719, 0.2311, 0.3517, 0.7193, -0.4127,
    0.3931, -0.2713, 0.1917, 0.1493, 1.1171, -0.8713,
    0.0913, 0.1319, 0.2137, 0.0071, -0.0133,
    0.2117, 0.1313, -0.0713, 0.1519,
    0.1337, 0.1213,
    0.0717, 0.0519,
    0.0319, -0.0217,
    0.4127, -0.2319, 0.1713, 0.0917,
], strict=True))


class FixedLinear:
    """A linear model with the literal coefficients above."""

    def transform(self, df: DataFrame) -> DataFrame:
        total = F.lit(INTERCEPT)
        for name, c in COEFFICIENTS.items():
            total = total + F.lit(c) * F.col(name)
        return df.withColumn("prediction", total)


_HISTORY = ["prev_day_demand", "prev_day_sold", "prev_day_waste", "prev_week_demand", "rolling_3day_demand",
            "rolling_7day_demand", "rolling_14day_demand", "rolling_30day_demand", "rolling_7day_std", "rolling_14day_std"]

_AGG = """count(*) AS n, max(date) AS last_date,
       max(customer_demand) FILTER (WHERE rn = 1) AS d1, max(quantity_sold) FILTER (WHERE rn = 1) AS s1,
       max(waste_quantity) FILTER (WHERE rn = 1) AS w1, max(customer_demand) FILTER (WHERE rn = 7) AS d7,
       avg(customer_demand) FILTER (WHERE rn <= 3) AS r3, avg(customer_demand) FILTER (WHERE rn <= 7) AS r7,
       avg(customer_demand) FILTER (WHERE rn <= 14) AS r14, avg(customer_demand) AS r30,
       coalesce(stddev_samp(customer_demand) FILTER (WHERE rn <= 7), 0) AS sd7,
       coalesce(stddev_samp(customer_demand) FILTER (WHERE rn <= 14), 0) AS sd14"""


def _state_sql(requests: str) -> str:
    """CTEs up to ``s0``: each request with its static features and day-1 history features."""
    pick = ", ".join(f"CASE WHEN s.n IS NOT NULL THEN s.{c} ELSE b.{c} END AS {c}"
                     for c in ("n", "last_date", "d1", "s1", "w1", "d7", "r3", "r7", "r14", "r30", "sd7", "sd14"))
    return f"""
stail AS (SELECT *, row_number() OVER (PARTITION BY business_type, item_name ORDER BY date DESC) AS rn FROM sales),
btail AS (SELECT *, row_number() OVER (PARTITION BY business_type ORDER BY date DESC, item_name DESC) AS rn FROM sales),
sstate AS (SELECT business_type, item_name, {_AGG} FROM stail WHERE rn <= 30 GROUP BY 1, 2),
bstate AS (SELECT business_type, {_AGG} FROM btail WHERE rn <= 30 GROUP BY 1),
joined AS (
  SELECT r.*, s.n IS NOT NULL AS has_series, {pick}
  FROM {requests} r LEFT JOIN sstate s ON r.business_type = s.business_type AND r.item_name = s.item_name
                    LEFT JOIN bstate b ON r.business_type = b.business_type),
{_s0_sql()}"""


def _s0_sql() -> str:
    """CTE ``s0`` over ``joined``: static features and day-1 history features."""
    cat, cx = item_sql()
    known = ", ".join(f"'{k}'" for k in KNOWN_ITEMS)
    return f"""
s0 AS (
  SELECT * EXCLUDE (n, last_date, d1, s1, w1, d7, r3, r7, r14, r30, sd7, sd14, category),
         {category_code_sql()} AS category_encoded, {business_code_sql()} AS business_encoded,
         CAST(starting_date AS DATE) AS day0, item_name NOT IN ({known}) AS is_new_item,
         date_diff('day', last_date, CAST(starting_date AS DATE)) AS stale_days,
         d1 AS h_prev_day_demand, s1 AS h_prev_day_sold, w1 AS h_prev_day_waste,
         CASE WHEN n >= 7 THEN d7 ELSE d1 END AS h_prev_week_demand, r3 AS h_rolling_3day_demand, r7 AS h_rolling_7day_demand,
         CASE WHEN n >= 14 THEN r14 ELSE r7 END AS h_rolling_14day_demand,
         CASE WHEN n >= 30 THEN r30 ELSE r7 END AS h_rolling_30day_demand, sd7 AS h_rolling_7day_std,
         CASE WHEN n >= 14 THEN sd14 ELSE sd7 END AS h_rolling_14day_std
  FROM (SELECT *, {cat} AS category, {cx} AS preparation_complexity FROM joined) j)"""


def _mean(ps: list[str]) -> str:
    return f"(({' + '.join(ps)}) / {len(ps)}.0)"


def _day_sql(k: int) -> str:
    """CTEs of day ``k`` (from 1): calendar ``c``, features ``f``, prediction ``s``."""
    if k == 1:
        hist = {name: f"h_{name}" for name in _HISTORY}
    else:
        ps = [f"p{i}" for i in range(1, k)]
        prev, mean = ps[-1], _mean(ps)
        squares = " + ".join(f"({p} - {mean}) * ({p} - {mean})" for p in ps)
        std = f"sqrt(({squares}) / {len(ps)}.0)" if len(ps) > 1 else "0.0"
        hist = {"prev_day_demand": prev, "prev_day_sold": f"{prev} * CAST(0.95 AS DOUBLE)", "prev_day_waste": "0.0", "prev_week_demand": prev,
                "rolling_3day_demand": _mean(ps[-3:]), "rolling_7day_demand": mean, "rolling_14day_demand": mean,
                "rolling_30day_demand": mean, "rolling_7day_std": std, "rolling_14day_std": std}
    two_pi = "6.283185307179586::DOUBLE"
    feats = {
        "day_of_week": "dow", "month": "month(d)", "week_of_year": "weekofyear(d)", "day_of_month": "dayofmonth(d)",
        "is_weekend": "wkd", "is_monday": "CAST(dow = 0 AS INTEGER)", "is_friday": "fri",
        "is_saturday": "CAST(dow = 5 AS INTEGER)", "is_sunday": "CAST(dow = 6 AS INTEGER)",
        "day_sin": f"sin({two_pi} * dow / 7)", "day_cos": f"cos({two_pi} * dow / 7)",
        "month_sin": f"sin({two_pi} * month(d) / 12)", "month_cos": f"cos({two_pi} * month(d) / 12)",
        "holiday_flag": "hol", "is_rainy": "rain", "category_encoded": "category_encoded",
        "preparation_complexity": "preparation_complexity", "business_encoded": "business_encoded", "price": "price",
        "shelf_life_hours": "shelf_life_hours", **hist, "weekend_x_holiday": "wkd * hol", "rainy_x_weekend": "rain * wkd",
        "rainy_x_holiday": "rain * hol", "friday_x_weekend": "fri * wkd",
    }
    total = f"CAST({INTERCEPT} AS DOUBLE)"
    for name, c in COEFFICIENTS.items():
        total += f" + CAST({c} AS DOUBLE) * CAST(coalesce({feats[name]}, 0) AS DOUBLE)"
    return f"""
c{k} AS (SELECT *, day0 + {k - 1} AS d, isodow(day0 + {k - 1}) - 1 AS dow, CAST(isodow(day0 + {k - 1}) >= 6 AS INTEGER) AS wkd,
         CAST(isodow(day0 + {k - 1}) = 5 AS INTEGER) AS fri, coalesce(holiday_flags[{k}], 0) AS hol,
         CAST(coalesce(weather_forecast[{k}] = 'Rainy', false) AS INTEGER) AS rain FROM s{k - 1}),
s{k} AS (SELECT * EXCLUDE (d, dow, wkd, fri, hol, rain), greatest(CAST(0 AS DOUBLE), round_even({total}, 0)) AS p{k},
         CAST(coalesce({hist['rolling_7day_demand']}, 0) AS DOUBLE) AS m{k} FROM c{k})"""


def forecast_sql(requests: str, keys: str, horizon: int = HORIZON_DAYS) -> str:
    """CTEs and SELECT of the whole forecast for the CTE ``requests``."""
    days = ",".join(_day_sql(k) for k in range(1, horizon + 1))
    ps, ms = ", ".join(f"p{k}" for k in range(1, horizon + 1)), ", ".join(f"m{k}" for k in range(1, horizon + 1))
    score = "round(greatest(0.55, 0.85 - i * 0.05), 2)"
    return f"""{_state_sql(requests)},{days},
days AS (SELECT *, day0 + CAST(i AS INTEGER) AS d, ([{ps}])[i + 1] AS p, ([{ms}])[i + 1] AS m, {score} AS score
         FROM s{horizon}, range(0, {horizon}) t(i))
SELECT {keys}, business_type, strftime(d, '%Y-%m-%d') AS date, dayname(d) AS day_name, i + 1 AS day_number,
       CAST(p AS BIGINT) AS predicted_demand, CAST(round_even(p * CAST(1.05 AS DOUBLE), 0) AS BIGINT) AS recommended_quantity,
       CASE WHEN score >= 0.75 THEN 'High' WHEN score >= 0.60 THEN 'Medium' ELSE 'Low' END AS confidence,
       score AS confidence_score, weather_forecast[i + 1] AS weather,
       CASE WHEN holiday_flags[i + 1] = 1 THEN 'Yes' ELSE 'No' END AS is_holiday, is_new_item,
       'Based on: ' || array_to_string(list_filter([
         CASE WHEN isodow(d) >= 6 AND business_type <> 'Cafe' THEN 'weekend uplift' END,
         CASE WHEN isodow(d) >= 6 AND business_type = 'Cafe' THEN 'weekend drop' END,
         CASE WHEN holiday_flags[i + 1] = 1 THEN 'holiday effect' END,
         CASE WHEN weather_forecast[i + 1] = 'Rainy' THEN 'rainy weather' END,
         '7-day avg (' || CAST(CAST(round_even(m, 0) AS BIGINT) AS VARCHAR) || ')'], lambda x: x IS NOT NULL)[1:3], ', ')
         AS explanation, has_series, stale_days
FROM days"""


COLS = ("request_id:s, item_name:s, business_type:s, date:s, day_name:s, day_number:i, predicted_demand:i, "
        "recommended_quantity:i, confidence:s, confidence_score:d, weather:s, is_holiday:s, is_new_item:b, explanation:s, "
        "has_series:b, stale_days:i")
_REQUESTS = with_sql(SALES_SQL, REQUESTS_SQL, SERIES_REQUESTS_SQL, VALID_REQUESTS_SQL)


@register("forecast_week_fixed", COLS, _REQUESTS + "," + forecast_sql("all_req", "request_id, item_name"))
def forecast_week_fixed(spark, sf_dir):
    """The 7-day recursive forecast of every series and valid menu request."""
    sales = td.load_sales(spark, sf_dir, materialize=True)
    return fc.forecast(FixedLinear(), sales, td.all_requests(spark, sf_dir, sales=sales))


_DAY_REQUESTS = """, day_req AS (SELECT request_id, item_name, business_type, price, shelf_life_hours, starting_date,
  ['Clear', 'Clear', 'Clear', 'Clear', 'Clear', 'Clear', 'Clear'] AS weather_forecast, [0, 0, 0, 0, 0, 0, 0] AS holiday_flags
  FROM series_req),"""


@register("forecast_day_fixed", COLS,
          with_sql(SALES_SQL, SERIES_REQUESTS_SQL) + _DAY_REQUESTS + forecast_sql("day_req", "request_id, item_name", 1))
def forecast_day_fixed(spark, sf_dir):
    """The single-day forecast of every series, default weather and flag."""
    sales = td.load_sales(spark, sf_dir, materialize=True)
    reqs = td.series_requests(sales).select(
        "request_id", "item_name", "business_type", "price", "shelf_life_hours", F.col("starting_date").alias("date"),
        F.lit(None).cast("string").alias("weather"), F.lit(None).cast("int").alias("is_holiday"))
    return fc.forecast_day(FixedLinear(), sales, reqs)


_MENU_REQUESTS = """, menu_req AS (
  SELECT item_id, item_name, m.business_type, price, shelf_life_hours,
         (SELECT strftime(max(date) + 1, '%Y-%m-%d') FROM sales) AS starting_date,
         [c.weather, c.weather, c.weather, c.weather, c.weather, c.weather, c.weather] AS weather_forecast,
         [c.hol, 0, 0, 0, 0, 0, 0] AS holiday_flags
  FROM menu m LEFT JOIN (VALUES ('Restaurant', 'Clear', 0), ('Cafe', 'Rainy', 0), ('Bakery', 'Clear', 1)) c(b, weather, hol)
    ON c.b = m.business_type),"""


@register("daily_forecasts_fixed",
          "item_id:i, item_name:s, business_type:s, date:s, predicted_demand:i, recommended_quantity:i, confidence:s, "
          "confidence_score:d, is_new_item:b",
          with_sql(SALES_SQL, MENU_SQL) + _MENU_REQUESTS + forecast_sql("menu_req", "item_id, item_name", 1))
def daily_forecasts_fixed(spark, sf_dir):
    """Every menu item with tomorrow's conditions of its business."""
    sales = td.load_sales(spark, sf_dir, materialize=True)
    conditions = spark.createDataFrame(
        [("Restaurant", "Clear", 0), ("Cafe", "Rainy", 0), ("Bakery", "Clear", 1)],
        "business_type string, weather string, is_holiday int")
    tomorrow = F.date_format(F.date_add(sales.agg(F.max("date")).scalar(), 1), "yyyy-MM-dd")
    return fc.generate_daily(FixedLinear(), sales, td.menu_items(td.table(spark, sf_dir, "part")), conditions, tomorrow)
