"""Registered queries: rolling-origin backtests by horizon (M13, H6) and permutation
importance (M11), both with the fixed linear model, which SQL can restate, and for
the backtest also with ridge models trained before the first origin."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlake.operators import features as fe
from demandlake.plans import backtest as bt
from demandlake.plans import models as md
from demandlake.plans.q_forecast_fixed import _AGG, COEFFICIENTS, INTERCEPT, FixedLinear, _day_sql, _s0_sql
from demandlake.plans.registry import register
from demandlake.plans.sqltext import features_sql
from demandlake.schema import FEATURE_COLS, HORIZON_BANDS, HORIZON_DAYS, LABEL_COL
from demandlake.session import cut_lineage, stored
from demandlake.sources import testdata as td
from demandlake.sources.testdata import SALES_SQL, with_sql

ORIGINS = 8
_DAYS = range(1, HORIZON_DAYS + 1)

_BACKTEST_SQL = with_sql(SALES_SQL) + f""",
origins AS (SELECT max(date) - CAST({HORIZON_DAYS} * k AS INTEGER) AS origin FROM sales, range(1, {ORIGINS + 1}) t(k) GROUP BY k),
ranked AS (SELECT s.*, origin, row_number() OVER (PARTITION BY origin, business_type, item_name ORDER BY date DESC) AS rn
           FROM sales s JOIN origins ON date <= origin),
past AS (SELECT origin, business_type, item_name, max(price) FILTER (WHERE rn = 1) AS price,
                max(shelf_life_hours) FILTER (WHERE rn = 1) AS shelf_life_hours, {_AGG}
         FROM ranked WHERE rn <= 30 GROUP BY 1, 2, 3),
future AS (SELECT origin, business_type, item_name,
                  {', '.join(f"max(weather_condition) FILTER (WHERE date - origin = {k}) AS fw{k}, "
                             f"max(holiday_flag) FILTER (WHERE date - origin = {k}) AS fh{k}, "
                             f"max(customer_demand) FILTER (WHERE date - origin = {k}) AS fa{k}" for k in _DAYS)}
           FROM sales JOIN origins ON date > origin AND date <= origin + {HORIZON_DAYS} GROUP BY 1, 2, 3),
joined AS (SELECT past.*, {', '.join(f'fa{k}' for k in _DAYS)}, strftime(past.origin + 1, '%Y-%m-%d') AS starting_date,
                  [{', '.join(f"coalesce(fw{k}, 'Clear')" for k in _DAYS)}] AS weather_forecast,
                  [{', '.join(f'coalesce(fh{k}, 0)' for k in _DAYS)}] AS holiday_flags
           FROM past JOIN future USING (origin, business_type, item_name)),{_s0_sql()},{",".join(_day_sql(k) for k in _DAYS)},
scored AS ({' UNION ALL '.join(f"SELECT business_type, item_name, origin, {k} AS day_number, fa{k} AS y, p{k} AS p FROM s{HORIZON_DAYS} WHERE fa{k} IS NOT NULL" for k in _DAYS)})
"""
_BAND = "CASE " + " ".join(f"WHEN day_number BETWEEN {a} AND {b} THEN '{n}'" for n, (a, b) in HORIZON_BANDS.items()) + " END"


def _origin_history(spark, sf_dir):
    return td.load_sales(spark, sf_dir, materialize=True)


@register("backtest_rows_fixed", "business_type:s, item_name:s, origin:t, day_number:i, y_true:d, y_pred:d",
          _BACKTEST_SQL + "SELECT business_type, item_name, origin, day_number, y AS y_true, p AS y_pred FROM scored")
def backtest_rows_fixed(spark, sf_dir):
    """H6 from eight weekly origins at once: every forecast day with its actual."""
    sales = _origin_history(spark, sf_dir)
    return bt.backtest(FixedLinear(), sales, bt.weekly_origins(sales, ORIGINS))


SCORE_COLS = "band:s, business_type:s, mae:d, mape:d, rmse:d, r2:d, n_predictions:i"


@register("backtest_horizon_fixed", SCORE_COLS, _BACKTEST_SQL + f"""
SELECT band, coalesce(business_type, 'All') AS business_type, avg(abs(y - p)) AS mae,
       avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)) * 100.0 AS mape, sqrt(avg((y - p) * (y - p))) AS rmse,
       CASE WHEN var_pop(y) * count(y) = 0 THEN CASE WHEN sum((y - p) * (y - p)) = 0 THEN 1.0 ELSE 0.0 END
            ELSE 1.0 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)) END AS r2, count(*) AS n_predictions
FROM (SELECT *, {_BAND} AS band FROM scored) b GROUP BY GROUPING SETS ((band), (band, business_type))""")
def backtest_horizon_fixed(spark, sf_dir):
    """Accuracy by days ahead (1-2, 3-5, 6-7) and business over eight weekly origins."""
    sales = _origin_history(spark, sf_dir)
    return bt.score_by_horizon(bt.backtest(FixedLinear(), sales, bt.weekly_origins(sales, ORIGINS)))


@register("backtest_horizon_ridge", "include_current:b, " + SCORE_COLS)
def backtest_horizon_ridge(spark, sf_dir):
    """M13 with ridge models that saw no day after the first origin; trained with the
    current row in its rolling features, as published, and with past rows only."""
    sales = _origin_history(spark, sf_dir)
    origins = bt.weekly_origins(sales, ORIGINS)
    states = cut_lineage(bt.origin_states(sales, origins))
    first = F.date_sub(sales.agg(F.max("date")).scalar(), ORIGINS * HORIZON_DAYS)
    feats = fe.build_features(sales, include_current=None).where(F.col("date") <= first)
    train = stored(feats.select(*FEATURE_COLS, *fe.past_columns(feats), LABEL_COL), "train")
    out = None
    for current in (True, False):
        model = md.ridge(1.0, stored=True).fit(fe.rolling_kind(train, current))
        scored = bt.backtest(model, sales, origins, states=states)
        rows = bt.score_by_horizon(scored).withColumn("include_current", F.lit(current))
        out = rows if out is None else out.unionByName(rows)
    return out


_PREDICTION = f"CAST({INTERCEPT} AS DOUBLE) + " + " + ".join(
    f"CAST({c} AS DOUBLE) * CAST({n} AS DOUBLE)" for n, c in COEFFICIENTS.items())
_KEYS = ["business_type", "item_name", "date"]


@register("importance_permutation_fixed", "feature:s, mae:d, base_mae:d, importance:d", with_sql(SALES_SQL, features_sql()) + f""",
placed AS (SELECT *, md5(business_type || '|' || item_name || '|' || CAST(date AS VARCHAR)) AS place FROM feats),
dealt AS (SELECT *, CAST('0x' || substr(place, 1, 4) AS INTEGER) % {md.SHUFFLE_GROUPS} AS grp FROM placed),
paired AS (SELECT *, {_PREDICTION} AS pred, {", ".join(
    f"coalesce(lag({n}) OVER w, last_value({n}) OVER whole) AS b_{n}" for n in FEATURE_COLS)}
  FROM dealt WINDOW w AS (PARTITION BY grp ORDER BY place, business_type, item_name, date),
    whole AS (PARTITION BY grp ORDER BY place, business_type, item_name, date
              ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
errors AS (SELECT avg(abs({LABEL_COL} - pred)) AS base_mae, [{", ".join(
    f"avg(abs({LABEL_COL} - (pred + CAST({c} AS DOUBLE) * (b_{n} - {n}))))" for n, c in COEFFICIENTS.items())}] AS maes
  FROM paired)
SELECT feature, mae, base_mae, mae - base_mae AS importance FROM (
  SELECT unnest([{", ".join(f"'{n}'" for n in FEATURE_COLS)}]) AS feature, unnest(maes) AS mae, base_mae FROM errors) u""")
def importance_permutation_fixed(spark, sf_dir):
    """M11 for a model without importances of its own: all features in one scored pass."""
    feats = cut_lineage(fe.build_features(td.load_sales(spark, sf_dir)))
    return md.permutation_importance(FixedLinear(), feats, _KEYS)
