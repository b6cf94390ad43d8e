"""Metrics (M5-M7) against numpy, monitoring (O1-O5) and run detection
(C9/C10) against brute force."""

import datetime as dt
import random

import numpy as np

from demandlake.functions import metrics as M
from demandlake.operators import monitor as mo


def _np_metrics(y, p):
    y, p = np.array(y, float), np.array(p, float)
    mape = np.mean(np.abs(y - p) / np.maximum(np.abs(y), np.finfo(float).eps)) * 100
    ss_res, ss_tot = np.sum((y - p) ** 2), np.sum((y - y.mean()) ** 2)
    r2 = (1.0 if ss_res == 0 else 0.0) if ss_tot == 0 else 1 - ss_res / ss_tot
    return np.mean(np.abs(y - p)), mape, np.sqrt(np.mean((y - p) ** 2)), r2


def _spark_metrics(spark, y, p):
    df = spark.createDataFrame(list(zip([float(v) for v in y], [float(v) for v in p])), "y_true double, y_pred double")
    r = df.agg(*M.metric_columns("y_true", "y_pred")).first()
    return r.mae, r.mape, r.rmse, r.r2


def test_reference_accuracy_case(spark):
    y, p = [40, 45, 38, 50, 42], [42, 43, 40, 48, 41]
    got, exp = _spark_metrics(spark, y, p), _np_metrics(y, p)
    np.testing.assert_allclose(got, exp, rtol=1e-12)
    assert round(got[0], 2) == 1.8 and round(got[2], 2) == 1.84


def test_zero_actual_and_constant_actuals(spark):
    got, exp = _spark_metrics(spark, [0, 10], [1, 10]), _np_metrics([0, 10], [1, 10])
    np.testing.assert_allclose(got, exp, rtol=1e-12)
    assert _spark_metrics(spark, [5, 5, 5], [5, 5, 5])[3] == 1.0
    assert _spark_metrics(spark, [5, 5, 5], [4, 5, 5])[3] == 0.0


def _log(spark, mapes):
    base = dt.datetime(2025, 1, 1)
    rows = [(base + dt.timedelta(days=i), 1.0, float(m), 1.0, 0.5, 5, "Cafe" if i % 2 else "Bakery", "Latte")
            for i, m in enumerate(mapes)]
    return spark.createDataFrame(rows, "timestamp timestamp, mae double, mape double, rmse double, r2 double, "
                                       "n_predictions bigint, business_type string, item_name string")


def test_recent_and_retraining(spark):
    log = _log(spark, [5, 5, 5, 20, 20, 20, 20, 20, 20, 20])
    r = mo.recent_performance(log, 7).first()
    assert r.n_entries == 7 and r.avg_mape == 20.0
    assert mo.needs_retraining(log).first().needs_retraining
    assert not mo.needs_retraining(_log(spark, [30] * 6)).first().needs_retraining  # fewer than 7 entries
    rep = mo.accuracy_report(log, business_type="Cafe", n=3).first()
    assert rep.period == "Last 3 evaluations" and rep.meets_target is False and rep.degraded is False
    none = mo.accuracy_report(log, item_name="Nothing").first()
    assert none["n_entries"] == 0 and none["alert_message"] == "No matching records found."


def _brute_runs(events):
    runs, cur = [], []
    for ts, eid, bad in sorted(events):
        if bad:
            cur.append(ts)
        elif cur:
            runs.append((cur[0], cur[-1], len(cur)))
            cur = []
    if cur:
        runs.append((cur[0], cur[-1], len(cur)))
    return sorted(runs)


def test_failure_islands_match_brute_force(spark):
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    events, t = [], base
    for i in range(600):
        t += dt.timedelta(minutes=rnd.choice([1, 3, 7, 20, 70]))
        bad = rnd.random() < (0.8 if (i // 40) % 3 == 0 else 0.2)
        events.append((t, i, bad))
    df = spark.createDataFrame([(ts, eid, bad) for ts, eid, bad in events], "ts timestamp, event_id bigint, failed boolean")
    got = sorted((r.run_start, r.run_end, r.n_events) for r in mo.failure_islands(df).collect())
    assert got == _brute_runs(events)
    assert max(n for _, _, n in got) > 10  # runs longer than a bucket edge exist


def test_request_metrics_and_runs(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(seconds=30 * i), i, "predict", 500 if 5 <= i < 17 else 200, 0.5, i % 5 == 0)
            for i in range(40)]
    log = spark.createDataFrame(rows, "ts timestamp, event_id bigint, endpoint string, status int, latency_s double, fallback boolean")
    m = mo.request_metrics(log).first()
    assert m.n_requests == 40 and abs(m.error_rate - 12 / 40) < 1e-12 and m.fallback_alert
    runs = mo.error_runs(log).collect()
    assert len(runs) == 1 and runs[0].n_events == 12
    out = mo.outages(log).collect()
    assert len(out) == 1 and out[0].duration_s == 330.0


def test_failure_islands_with_a_burst(spark):
    """A third of all events inside one second: the range buckets split
    the burst, and the stitched runs still equal brute force."""
    rnd = random.Random(11)
    base = dt.datetime(2024, 1, 1)
    events = []
    for i in range(900):
        if i < 300:
            t = base + dt.timedelta(microseconds=i)  # the burst
        else:
            t = base + dt.timedelta(seconds=1 + (i - 300) * 90)
        events.append((t, i, rnd.random() < 0.6))
    df = spark.createDataFrame(events, "ts timestamp, event_id bigint, failed boolean")
    for n in (1, 5, 16):
        got = sorted((r.run_start, r.run_end, r.n_events) for r in mo.failure_islands(df, n_ranges=n).collect())
        assert got == _brute_runs(events)
