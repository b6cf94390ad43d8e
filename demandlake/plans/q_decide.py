"""Registered queries: decisions (D1, D2) and contract table jobs (C2-C4,
C6, C7, C11)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from demandlake.operators import contract as ct
from demandlake.operators import decide as dc
from demandlake.plans.registry import register
from demandlake.session import work_dir
from demandlake.sources import testdata as td
from demandlake.sources.stored import StoredTable
from demandlake.sources.testdata import NAIVE_SQL, PLANS_SQL, REQUESTS_SQL, SALES_SQL, with_sql

P = with_sql(SALES_SQL, NAIVE_SQL, PLANS_SQL)
KEYS = "business_type:s, item_name:s, date:t"

_RISK_SQL = """
  CASE WHEN planned_quantity = 0 THEN 'LOW'
       WHEN CAST(planned_quantity - predicted_demand AS DOUBLE) / planned_quantity * 100.0 > 15 THEN 'HIGH'
       WHEN CAST(planned_quantity - predicted_demand AS DOUBLE) / planned_quantity * 100.0 > 5 THEN 'MEDIUM'
       ELSE 'LOW' END"""


def _plans(spark, sf_dir):
    return td.plans(td.load_sales(spark, sf_dir))


@register(
    "plan_waste_risk",
    f"{KEYS}, predicted_demand:i, planned_quantity:i, risk_level:s, waste_percentage:d, expected_waste:i, message:s, color:s",
    P + f"""SELECT business_type, item_name, date, predicted_demand, planned_quantity, risk_level,
       CASE WHEN planned_quantity = 0 THEN 0.0
            ELSE round(CAST(planned_quantity - predicted_demand AS DOUBLE) / planned_quantity * 100.0, 2) END AS waste_percentage,
       CASE WHEN planned_quantity = 0 THEN 0 ELSE greatest(planned_quantity - predicted_demand, 0) END AS expected_waste,
       CASE WHEN planned_quantity = 0 THEN 'No production planned.'
            WHEN risk_level = 'HIGH' THEN 'High waste risk - reduce quantity.'
            WHEN risk_level = 'MEDIUM' THEN 'Moderate waste risk - consider reducing.'
            ELSE 'Good planning - minimal waste expected.' END AS message,
       CASE WHEN risk_level = 'HIGH' THEN 'red' WHEN risk_level = 'MEDIUM' THEN 'yellow' ELSE 'green' END AS color
FROM (SELECT *, {_RISK_SQL} AS risk_level FROM plans) p""",
)
def plan_waste_risk(spark, sf_dir):
    """D1 over every plan: the made quantity vs the forecast of the day."""
    return dc.add_waste_risk(_plans(spark, sf_dir))


@register(
    "plan_recommendation",
    f"{KEYS}, predicted_demand:i, current_plan:i, recommended_quantity:i, difference:i, action:s, reason:s, explanation:s",
    P + """SELECT business_type, item_name, date, predicted_demand, current_plan, rec AS recommended_quantity,
       rec - current_plan AS difference,
       CASE WHEN rec - current_plan < -5 THEN 'REDUCE by ' || CAST(abs(rec - current_plan) AS VARCHAR) || ' units'
            WHEN rec - current_plan > 5 THEN 'INCREASE by ' || CAST(rec - current_plan AS VARCHAR) || ' units'
            ELSE 'MAINTAIN current plan' END AS action,
       CASE WHEN rec - current_plan < -5 THEN 'Current plan exceeds predicted demand - reducing avoids waste.'
            WHEN rec - current_plan > 5 THEN 'Current plan is below predicted demand - increasing avoids stockouts.'
            ELSE 'Current plan is within the optimal range.' END AS reason,
       'Predicted demand: ' || CAST(predicted_demand AS VARCHAR) || ' units. With 5% safety buffer → recommend '
         || CAST(rec AS VARCHAR) || ' units.' AS explanation
FROM (SELECT *, planned_quantity AS current_plan, CAST(round_even(predicted_demand * 1.05, 0) AS BIGINT) AS rec FROM plans) p""",
)
def plan_recommendation(spark, sf_dir):
    """D2 over every plan: buffered quantity and the action text."""
    df = _plans(spark, sf_dir).withColumnRenamed("planned_quantity", "current_plan")
    return dc.add_recommendation(df)


@register(
    "plans_without_forecast",
    f"{KEYS}, planned_quantity:i",
    with_sql(SALES_SQL, NAIVE_SQL) + """SELECT s.business_type, s.item_name, s.date, s.quantity_available AS planned_quantity
FROM sales s ANTI JOIN naive n ON s.business_type = n.business_type AND s.item_name = n.item_name AND s.date = n.date""",
)
def plans_without_forecast(spark, sf_dir):
    """Plans (every sales day) with no forecast row are reported."""
    sales = td.load_sales(spark, sf_dir)
    plans = sales.select("business_type", "item_name", "date", F.col("quantity_available").alias("planned_quantity"))
    forecasts = td.plans(sales)
    _, unmatched = dc.check_plans(plans, forecasts)
    return unmatched


@register(
    "high_risk_plans",
    f"{KEYS}, predicted_demand:i, planned_quantity:i, waste_percentage:d, expected_waste:i",
    P + f"""SELECT business_type, item_name, date, predicted_demand, planned_quantity,
       round(CAST(planned_quantity - predicted_demand AS DOUBLE) / planned_quantity * 100.0, 2) AS waste_percentage,
       greatest(planned_quantity - predicted_demand, 0) AS expected_waste
FROM plans WHERE {_RISK_SQL} = 'HIGH'""",
)
def high_risk_plans(spark, sf_dir):
    """C3 + C6: plans joined to forecasts, scored, HIGH risk only."""
    sales = td.load_sales(spark, sf_dir)
    plans = sales.select("business_type", "item_name", "date", F.col("quantity_available").alias("planned_quantity"))
    scored, _ = dc.check_plans(plans, td.plans(sales))
    return dc.high_risk(scored)


@register(
    "default_demand_fill",
    f"{KEYS}, predicted_demand:i, used_default:b",
    with_sql(SALES_SQL) + """SELECT business_type, item_name, date,
       coalesce(p, CASE business_type WHEN 'Restaurant' THEN 40 WHEN 'Cafe' THEN 50 WHEN 'Bakery' THEN 60 END) AS predicted_demand,
       p IS NULL AS used_default
FROM (SELECT *, lag(customer_demand, 7) OVER (PARTITION BY business_type, item_name ORDER BY date) AS p FROM sales) s""",
)
def default_demand_fill(spark, sf_dir):
    """Business default demand (40/50/60) where no forecast exists."""
    sales = td.load_sales(spark, sf_dir)
    w = Window.partitionBy("business_type", "item_name").orderBy("date")
    df = sales.select("business_type", "item_name", "date",
                      F.lag("customer_demand", 7).over(w).alias("predicted_demand"))
    return dc.default_demand(df)


_FC_SQL = """
fc_old AS (SELECT business_type, item_name, date AS forecast_date, CAST(y_pred AS BIGINT) AS predicted_demand,
                  1 AS version FROM naive),
fc_new AS (SELECT business_type, item_name, date AS forecast_date, p1 AS predicted_demand, 2 AS version
           FROM (SELECT *, lag(customer_demand, 1) OVER (PARTITION BY business_type, item_name ORDER BY date) AS p1
                 FROM sales) s
           WHERE p1 IS NOT NULL AND date > (SELECT max(date) FROM sales) - INTERVAL 60 DAY)
"""


_FORECAST_DDL = "business_type string, item_name string, forecast_date date, predicted_demand bigint, version int"


def _forecast_versions(spark, sf_dir):
    sales = td.load_sales(spark, sf_dir, materialize=True)
    old = td.plans(sales).select("business_type", "item_name", F.col("date").alias("forecast_date"),
                                 "predicted_demand", F.lit(1).alias("version"))
    w = Window.partitionBy("business_type", "item_name").orderBy("date")
    last = sales.agg(F.max("date")).scalar()
    new = (sales.withColumn("p1", F.lag("customer_demand", 1).over(w))
           .where(F.col("p1").isNotNull() & (F.col("date") > F.date_sub(last, 60)))
           .select("business_type", "item_name", F.col("date").alias("forecast_date"),
                   F.col("p1").alias("predicted_demand"), F.lit(2).alias("version")))
    return old, new


@register(
    "forecast_upsert",
    "business_type:s, item_name:s, forecast_date:t, predicted_demand:i, version:i",
    with_sql(SALES_SQL, NAIVE_SQL, _FC_SQL) + """SELECT business_type, item_name, forecast_date,
       arg_max(predicted_demand, version) AS predicted_demand, max(version) AS version
FROM (SELECT * FROM fc_old UNION ALL SELECT * FROM fc_new) u GROUP BY 1, 2, 3""",
)
def forecast_upsert(spark, sf_dir):
    """C4: unique (business, item, forecast_date); the newer version wins."""
    old, new = _forecast_versions(spark, sf_dir)
    return ct.upsert(old, new, ["business_type", "item_name", "forecast_date"], "version")


@register(
    "forecast_merge_stored",
    "business_type:s, item_name:s, forecast_date:t, predicted_demand:i, version:i",
    with_sql(SALES_SQL, NAIVE_SQL, _FC_SQL) + """SELECT business_type, item_name, forecast_date,
       arg_max(predicted_demand, version) AS predicted_demand, max(version) AS version
FROM (SELECT * FROM fc_old UNION ALL SELECT * FROM fc_new) u GROUP BY 1, 2, 3""",
)
def forecast_merge_stored(spark, sf_dir):
    """C4 on a stored table: the forecasts are merged version by version, each merge rewriting the
    hash parts of its keys only; the newest version is read back."""
    old, new = _forecast_versions(spark, sf_dir)
    table = StoredTable(spark, work_dir(spark, "forecasts"), _FORECAST_DDL, ["business_type", "item_name", "forecast_date"],
                        "version", parts=16)
    table.merge(old)
    table.merge(new)
    return table.read()


@register(
    "todays_forecasts",
    "item_id:s, item_name:s, predicted_demand:i, recommended_quantity:i",
    with_sql(SALES_SQL, NAIVE_SQL) + """, menu AS (
  SELECT DISTINCT business_type, item_name, substr(md5(business_type || '|' || item_name), 1, 16) AS item_id FROM sales)
SELECT m.item_id, f.item_name, CAST(f.y_pred AS BIGINT) AS predicted_demand,
       CAST(round_even(f.y_pred * 1.05, 0) AS BIGINT) AS recommended_quantity
FROM naive f JOIN menu m ON f.business_type = m.business_type AND f.item_name = m.item_name
WHERE f.business_type = 'Restaurant' AND f.date = (SELECT max(date) FROM sales)""",
)
def todays_forecasts(spark, sf_dir):
    """The latest day's forecasts of one business with menu ids, by item."""
    from demandlake.functions.rules import recommended_quantity

    sales = td.load_sales(spark, sf_dir, materialize=True)
    fc = td.plans(sales).select("business_type", "item_name", F.col("date").alias("forecast_date"),
                                "predicted_demand",
                                recommended_quantity("predicted_demand").alias("recommended_quantity"))
    # Menu ids: an md5 prefix of the natural key (stable across runs).
    menu = sales.select("business_type", "item_name").distinct().withColumn(
        "item_id", F.substring(F.md5(F.concat_ws("|", "business_type", "item_name")), 1, 16))
    today = sales.agg(F.max("date")).scalar()
    return ct.todays_forecasts(fc, menu, "Restaurant", today)


@register(
    "default_weather",
    "request_id:i, weather:s",
    with_sql(REQUESTS_SQL) + """SELECT request_id,
       array_to_string(coalesce(CASE WHEN shelf_life_hours * 2 = 7 THEN NULL ELSE weather_forecast END,
                                ['Clear', 'Clear', 'Clear', 'Clear', 'Clear', 'Clear', 'Clear']), ',') AS weather
FROM requests""",
)
def default_weather(spark, sf_dir):
    """C11: a missing weather array (requests of size-7 parts carry none)
    becomes seven 'Clear' days."""
    req = td.week_requests(td.table(spark, sf_dir, "part"))
    req = req.withColumn("weather_forecast",
                         F.when(F.col("shelf_life_hours") * 2 == 7, F.lit(None)).otherwise(F.col("weather_forecast")))
    out = ct.default_weather(req)
    return out.select("request_id", F.array_join("weather_forecast", ",").alias("weather"))
