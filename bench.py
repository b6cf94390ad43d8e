"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion into Spark's ``noop`` sink (the whole plan
executes, nothing is collected to the driver). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "sales_daily",               # scan + join + partial/final aggregate
    "features_full",             # 34 features: one exchange, one window pass
    "eda_describe",              # exact quartiles
    "eda_weather_impact",
    "eda_correlation",
    "eda_histogram_demand",
    "quality_sales_checks",      # all row rules in one pass + duplicate keys
    "upload_quarantine",         # row rules over lineitem-sized uploads
    "plan_waste_risk",
    "accuracy_log_weekly",
    "forecast_history_state",    # W5/W6 tails + request joins
    "failure_runs",              # bucketed islands over the request log
    "request_metrics",
    "forecast_week_fixed",       # 7-step recursive forecast, fixed linear model
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from demandlake.plans import catalog
    from demandlake.session import local_session

    spark = local_session(cpus, app="demandlake-bench")
    qs = catalog.queries()
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    # JVM/JIT warm-up on the smallest scale factor (different files, so no
    # result or cache is reused by the timed runs).
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if warm and os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf_dir):
        for name in names:
            qs[name](spark, warm).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
