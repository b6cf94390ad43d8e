"""Registered queries: accuracy metrics and monitoring
and request-log analytics (C5, C8-C10)."""

from __future__ import annotations

from demandlake.operators import monitor as mo
from demandlake.plans.registry import register
from demandlake.sources import testdata as td
from demandlake.sources.testdata import (
    ACCURACY_LOG_SQL,
    NAIVE_SQL,
    REQUEST_LOG_SQL,
    SALES_SQL,
    with_sql,
)

N = with_sql(SALES_SQL, NAIVE_SQL)
L = with_sql(SALES_SQL, NAIVE_SQL, ACCURACY_LOG_SQL)
R = with_sql(REQUEST_LOG_SQL)

_METRICS_SQL = """avg(abs(y_true - y_pred)) AS mae,
       avg(abs(y_true - y_pred) / greatest(abs(y_true), 2.220446049250313e-16)) * 100.0 AS mape,
       sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse,
       CASE WHEN var_pop(y_true) * count(y_true) = 0
            THEN CASE WHEN sum((y_true - y_pred) * (y_true - y_pred)) = 0 THEN 1.0 ELSE 0.0 END
            ELSE 1.0 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(y_true)) END AS r2,
       count(y_true) AS n_predictions"""
MCOLS = "mae:d, mape:d, rmse:d, r2:d, n_predictions:i"


def _pairs(spark, sf_dir):
    return td.naive_pairs(td.load_sales(spark, sf_dir))


def _log(spark, sf_dir):
    return td.accuracy_log(td.load_sales(spark, sf_dir), td.series_parts(spark, sf_dir))


def _reqlog(spark, sf_dir):
    return td.request_log(td.table(spark, sf_dir, "events"))


@register("accuracy_overall", MCOLS + ", n_excluded:i",
          N + f"SELECT {_METRICS_SQL}, (SELECT count(*) FROM naive_all WHERE y_pred IS NULL) AS n_excluded FROM naive")
def accuracy_overall(spark, sf_dir):
    """M5-M7: MAE, MAPE, RMSE, R2 of the naive forecast over all complete pairs,
    and the number of rows without a forecast."""
    return mo.accuracy(td.naive_pairs(td.load_sales(spark, sf_dir), complete=False))


@register("accuracy_by_business", f"business_type:s, {MCOLS}",
          N + f"SELECT business_type, {_METRICS_SQL} FROM naive GROUP BY 1")
def accuracy_by_business(spark, sf_dir):
    """Metrics per business type."""
    return mo.accuracy(_pairs(spark, sf_dir), by=["business_type"])


@register(
    "score_actuals_by_series",
    f"business_type:s, item_name:s, {MCOLS}, drift:b",
    N + f"""SELECT business_type, item_name, round(mae, 2) AS mae, round(mape, 2) AS mape, round(rmse, 2) AS rmse,
       CAST(round(CAST(r2 AS DECIMAL(38, 9)), 3) AS DOUBLE) AS r2, n_predictions, round(mape, 2) > 25 AS drift
FROM (SELECT business_type, item_name, {_METRICS_SQL} FROM naive GROUP BY 1, 2) s""",
)
def score_actuals_by_series(spark, sf_dir):
    """O1 + O2: log rows for every series in one pass, with drift flag."""
    return mo.score_actuals(_pairs(spark, sf_dir))


@register("accuracy_log_weekly", f"business_type:s, item_name:s, timestamp:t, {MCOLS}, drift:b",
          L + "SELECT * FROM acclog")
def accuracy_log_weekly(spark, sf_dir):
    """O1 per (series, week): the accuracy log the monitoring reads."""
    return _log(spark, sf_dir)


_RECENT = "(SELECT * FROM acclog ORDER BY timestamp DESC, business_type DESC, item_name DESC LIMIT {n})"


@register(
    "recent_performance",
    "n_entries:i, avg_mape:d, avg_mae:d, avg_r2:d",
    L + f"""SELECT count(*) AS n_entries, round(avg(mape), 2) AS avg_mape, round(avg(mae), 2) AS avg_mae,
       round(avg(r2), 3) AS avg_r2 FROM {_RECENT.format(n=7)} r""",
)
def recent_performance(spark, sf_dir):
    """O3: means over the latest 7 log entries."""
    return mo.recent_performance(_log(spark, sf_dir), 7)


@register(
    "needs_retraining",
    "n_entries:i, avg_mape:d, needs_retraining:b",
    L + f"""SELECT (SELECT count(*) FROM acclog) AS n_entries, avg(mape) AS avg_mape,
       (SELECT count(*) FROM acclog) >= 7 AND coalesce(avg(mape) > 12.0, false) AS needs_retraining
FROM {_RECENT.format(n=7)} r""",
)
def needs_retraining(spark, sf_dir):
    """At least 7 entries and latest-7 mean MAPE above 12."""
    return mo.needs_retraining(_log(spark, sf_dir))


@register(
    "accuracy_report_cafe",
    "period:s, n_entries:i, avg_mape:d, avg_mae:d, avg_r2:d, degraded:b, target_mape:d, meets_target:b, alert_message:s",
    L + """SELECT 'Last ' || CAST(n_entries AS VARCHAR) || ' evaluations' AS period, n_entries, avg_mape, avg_mae, avg_r2,
       avg_mape > 25 AS degraded, 20.0 AS target_mape, avg_mape < 20 AS meets_target,
       CASE WHEN n_entries = 0 THEN 'No matching records found.'
            WHEN avg_mape > 25 THEN 'Model accuracy degraded - consider retraining.' END AS alert_message
FROM (SELECT count(*) AS n_entries, round(avg(mape), 2) AS avg_mape, round(avg(mae), 2) AS avg_mae,
             round(avg(r2), 3) AS avg_r2
      FROM (SELECT * FROM acclog WHERE business_type = 'Cafe'
            ORDER BY timestamp DESC, business_type DESC, item_name DESC LIMIT 7) r) a""",
)
def accuracy_report_cafe(spark, sf_dir):
    """Report over the latest 7 Cafe entries."""
    return mo.accuracy_report(_log(spark, sf_dir), business_type="Cafe", n=7)


@register(
    "accuracy_report_none",
    "period:s, n_entries:i, avg_mape:d, meets_target:b, alert_message:s",
    L + """SELECT 'Last 0 evaluations' AS period, count(*) AS n_entries, avg(mape) AS avg_mape, avg(mape) < 20 AS meets_target,
       'No matching records found.' AS alert_message FROM acclog WHERE item_name = 'No such dish'""",
)
def accuracy_report_none(spark, sf_dir):
    """The answer when no entry matches."""
    return mo.accuracy_report(_log(spark, sf_dir), item_name="No such dish", n=7)


@register(
    "rising_mape_weeks",
    "business_type:s, item_name:s, week:t, weekly_mape:d",
    L + """SELECT business_type, item_name, week, weekly_mape FROM (
  SELECT *, date_diff('day', lag(week, 3) OVER w, week) = 21 AS next_to, lag(weekly_mape, 1) OVER w AS l1, lag(weekly_mape, 2) OVER w AS l2, lag(weekly_mape, 3) OVER w AS l3
  FROM (SELECT business_type, item_name, date_trunc('week', timestamp) AS week, avg(mape) AS weekly_mape
        FROM acclog GROUP BY 1, 2, 3) x
  WINDOW w AS (PARTITION BY business_type, item_name ORDER BY week)) y
WHERE coalesce(weekly_mape > l1, false) AND coalesce(l1 > l2, false) AND coalesce(l2 > l3, false) AND coalesce(next_to, false)""",
)
def rising_mape_weeks(spark, sf_dir):
    """Weeks where MAPE rose three weeks in a row, per series."""
    return mo.rising_weeks(_log(spark, sf_dir))


@register(
    "request_metrics",
    "endpoint:s, n_requests:i, mean_latency_s:d, error_rate:d, fallback_rate:d, fallback_alert:b, latency_level:s",
    R + """SELECT *, fallback_rate > 0.1 AS fallback_alert,
       CASE WHEN mean_latency_s > 10 THEN 'critical' WHEN mean_latency_s > 3 THEN 'warning' ELSE 'ok' END AS latency_level
FROM (SELECT endpoint, count(*) AS n_requests, avg(latency_s) AS mean_latency_s,
             count(*) FILTER (WHERE status >= 400) / count(*) AS error_rate,
             count(*) FILTER (WHERE fallback) / count(*) AS fallback_rate
      FROM reqlog GROUP BY 1) m""",
)
def request_metrics(spark, sf_dir):
    """Per-endpoint counts, latency, error and fallback rates, alerts."""
    return mo.request_metrics(_reqlog(spark, sf_dir))


_RUNS_SQL = R + """, g AS (
  SELECT *, status >= 500 AS failed,
         sum(CASE WHEN status >= 500 THEN 0 ELSE 1 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp
  FROM reqlog),
runs AS (SELECT min(ts) AS run_start, max(ts) AS run_end, count(*) AS n_events FROM g WHERE failed GROUP BY grp)
"""


@register("failure_runs", "run_start:t, run_end:t, n_events:i", _RUNS_SQL + "SELECT * FROM runs")
def failure_runs(spark, sf_dir):
    """Every maximal run of consecutive failed requests (the islands C9
    and C10 are built on), found per hour bucket and stitched."""
    from pyspark.sql import functions as F

    log = _reqlog(spark, sf_dir).withColumn("failed", F.col("status") >= 500)
    return mo.failure_islands(log)


@register("error_runs", "run_start:t, run_end:t, n_events:i", _RUNS_SQL + "SELECT * FROM runs WHERE n_events > 10")
def error_runs(spark, sf_dir):
    """More than 10 consecutive failed requests."""
    return mo.error_runs(_reqlog(spark, sf_dir))


@register(
    "outages",
    "run_start:t, run_end:t, n_events:i, duration_s:d",
    _RUNS_SQL + """SELECT *, (epoch_us(run_end) - epoch_us(run_start)) / 1e6 AS duration_s FROM runs
WHERE (epoch_us(run_end) - epoch_us(run_start)) / 1e6 > 300""",
)
def outages(spark, sf_dir):
    """Failure runs lasting more than 5 minutes."""
    return mo.outages(_reqlog(spark, sf_dir))
