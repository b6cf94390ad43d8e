"""Accuracy monitoring and request-log analytics (M5-M7, M13, O1-O5,
C5, C8-C10).

Scoring groups every series in one aggregation (the reference scores one
call at a time). "Last n log entries" is a top-k (TakeOrderedAndProject:
each partition keeps n rows, then a merge), never a global sort. Run
detection over the request log uses size-balanced range buckets: islands
are found inside each bucket in parallel and only the pieces that touch a
bucket edge are stitched, over a table with at most two pieces per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlake.functions import metrics as M
from demandlake.schema import (
    ALERT_ERROR_RUN,
    ALERT_FALLBACK_RATE,
    ALERT_LATENCY_CRIT_S,
    ALERT_LATENCY_WARN_S,
    ALERT_OUTAGE_MINUTES,
    DEGRADED_TEXT,
    DRIFT_MAPE,
    NO_RECORDS_TEXT,
    RECENT_WINDOW,
    RETRAIN_MAPE,
    RETRAIN_WINDOW,
    TARGET_MAPE,
)
from demandlake.session import cut_lineage


def accuracy(df: DataFrame, by: Sequence[str] = (), y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """M5-M7 (and M13 with ``by``): unrounded mae, mape, rmse, r2, n."""
    return df.groupBy(*by).agg(*M.metric_columns(y, p))


def score_actuals(df: DataFrame, by: Sequence[str] = ("business_type", "item_name"),
                  y: str = "y_true", p: str = "y_pred", ts: str | None = None) -> DataFrame:
    """O1 + O2: accuracy-log rows (mae, mape, rmse at 2 places, r2 at 3,
    n_predictions, drift when mape > 25) for every group in one pass.
    ``ts`` adds a log timestamp per group (its latest value). r2 is rounded at 9
    places first, so noise in the last bits cannot tip a tie."""
    keys = list(by) + ([F.date_trunc("week", ts).alias("timestamp")] if ts else [])
    out = df.groupBy(*keys).agg(*M.metric_columns(y, p)).select(
        *[k for k in by], *(["timestamp"] if ts else []),
        F.round("mae", 2).alias("mae"), F.round("mape", 2).alias("mape"),
        F.round("rmse", 2).alias("rmse"), F.round(F.round("r2", 9), 3).alias("r2"), "n_predictions",
    )
    return out.withColumn("drift", F.col("mape") > DRIFT_MAPE)


def recent_entries(log: DataFrame, n: int = RECENT_WINDOW, item_name: str | None = None,
                   business_type: str | None = None, ts: str = "timestamp") -> DataFrame:
    """The latest ``n`` log rows after optional filters (top-k; ties
    broken by business then item so the choice is stable)."""
    if n < 1:
        raise ValueError("n must be at least 1")
    if item_name is not None:
        log = log.where(F.col("item_name") == item_name)
    if business_type is not None:
        log = log.where(F.col("business_type") == business_type)
    return log.orderBy(F.col(ts).desc(), F.col("business_type").desc_nulls_last(),
                       F.col("item_name").desc_nulls_last()).limit(n)


def recent_performance(log: DataFrame, n: int = RECENT_WINDOW, **filters) -> DataFrame:
    """O3: means over the latest ``n`` entries (mape/mae at 2 places, r2 at 3)."""
    r = recent_entries(log, n, **filters)
    return r.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_entries"),
        F.round(F.avg("mape"), 2).alias("avg_mape"),
        F.round(F.avg("mae"), 2).alias("avg_mae"),
        F.round(F.avg("r2"), 3).alias("avg_r2"),
    )


def needs_retraining(log: DataFrame, threshold_mape: float = RETRAIN_MAPE,
                     window: int = RETRAIN_WINDOW) -> DataFrame:
    """True when the log has at least ``window`` entries and the mean
    MAPE of the latest ``window`` is above ``threshold_mape``."""
    r = recent_entries(log, window)
    total = log.agg(F.count(F.lit(1)).cast("bigint")).scalar()
    return r.agg(F.avg("mape").alias("avg_mape")).select(
        total.alias("n_entries"),
        "avg_mape",
        ((total >= window) & F.coalesce(F.col("avg_mape") > threshold_mape, F.lit(False))).alias("needs_retraining"),
    )


def accuracy_report(log: DataFrame, item_name: str | None = None, business_type: str | None = None,
                    n: int = RECENT_WINDOW) -> DataFrame:
    """Filtered latest-n summary with degraded / meets_target flags and the
    alert text; one row also when nothing matches."""
    r = recent_performance(log, n, item_name=item_name, business_type=business_type)
    return r.select(
        F.concat(F.lit("Last "), F.col("n_entries").cast("string"), F.lit(" evaluations")).alias("period"),
        "n_entries", "avg_mape", "avg_mae", "avg_r2",
        (F.col("avg_mape") > DRIFT_MAPE).alias("degraded"),
        F.lit(TARGET_MAPE).alias("target_mape"),
        (F.col("avg_mape") < TARGET_MAPE).alias("meets_target"),
        F.when(F.col("n_entries") == 0, NO_RECORDS_TEXT).when(F.col("avg_mape") > DRIFT_MAPE, DEGRADED_TEXT)
        .alias("alert_message"),
    )


def rising_weeks(log: DataFrame, n: int = 3, by: Sequence[str] = ("business_type", "item_name"),
                 ts: str = "timestamp") -> DataFrame:
    """Weeks whose mean MAPE rose for ``n`` consecutive calendar weeks per
    group (a missing week ends the run).

    Weekly means are one row per (group, week); the lag window runs over
    that calendar-bounded table."""
    by = list(by)
    weekly = log.groupBy(*by, F.date_trunc("week", ts).alias("week")).agg(F.avg("mape").alias("weekly_mape"))
    w = Window.partitionBy(*by).orderBy("week")
    cond = F.lit(True)
    for k in range(n):
        cur = F.col("weekly_mape") if k == 0 else F.lag("weekly_mape", k).over(w)
        prev = F.lag("weekly_mape", k + 1).over(w)
        next_to = F.datediff("week", F.lag("week", k + 1).over(w)) == 7 * (k + 1)
        cond = cond & F.coalesce((cur > prev) & next_to, F.lit(False))
    return weekly.withColumn("rising", cond).where("rising").drop("rising")


def request_metrics(log: DataFrame) -> DataFrame:
    """Per endpoint request count, mean latency, error (4xx and 5xx) and
    fallback rates, with alert flags."""
    out = log.groupBy("endpoint").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_requests"),
        F.avg("latency_s").alias("mean_latency_s"),
        (F.count_if(F.col("status") >= 400) / F.count(F.lit(1))).alias("error_rate"),
        (F.count_if(F.col("fallback")) / F.count(F.lit(1))).alias("fallback_rate"),
    )
    return out.withColumns({
        "fallback_alert": F.col("fallback_rate") > ALERT_FALLBACK_RATE,
        "latency_level": F.when(F.col("mean_latency_s") > ALERT_LATENCY_CRIT_S, "critical")
        .when(F.col("mean_latency_s") > ALERT_LATENCY_WARN_S, "warning").otherwise("ok"),
    })


def failure_islands(log: DataFrame, failed: str = "failed", ts: str = "ts", tie: str = "event_id",
                    n_ranges: int | None = None, with_ids: bool = False) -> DataFrame:
    """Maximal runs of consecutive failed events in (ts, tie) order:
    (run_start, run_end, n_events), ``with_ids`` also (first_id, last_id).

    Events are range-partitioned on (ts, tie) into ``n_ranges`` contiguous,
    size-balanced buckets (bounds come from a sample, so a burst that holds
    a third of all events is split over many buckets rather than landing in
    one task). Within a bucket each failed event is labelled by the number
    of good events before it; runs inside a bucket are final, and runs
    touching a bucket edge are stitched across consecutive non-empty buckets
    over a table of at most two pieces per bucket."""
    spark = log.sparkSession
    n = n_ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                        spark.sparkContext.defaultParallelism)
    ev = (log.select(F.col(ts).alias("_ts"), F.col(tie).alias("_tie"), F.col(failed).cast("boolean").alias("_bad"))
          .repartitionByRange(n, "_ts", "_tie")
          .withColumn("_bucket", F.spark_partition_id()))
    wb = Window.partitionBy("_bucket").orderBy("_ts", "_tie")
    ev = ev.withColumns({
        "_good_before": F.sum(F.when(F.col("_bad"), 0).otherwise(1)).over(
            wb.rowsBetween(Window.unboundedPreceding, 0)),
        "_seq": F.row_number().over(wb),
        "_size": F.count(F.lit(1)).over(Window.partitionBy("_bucket")),
    })
    # One aggregate gives the failed pieces and, under a null label, one row per
    # bucket that holds good events: edges and buckets come from the same exchange.
    label = F.when(F.col("_bad"), F.col("_good_before"))
    pieces = ev.groupBy("_bucket", label.alias("_good_before")).agg(
        F.min(F.struct("_ts", "_tie")).alias("_first"), F.max(F.struct("_ts", "_tie")).alias("_last"),
        F.count(F.lit(1)).cast("bigint").alias("n_events"),
        F.min("_seq").alias("_min_seq"), F.max("_seq").alias("_max_seq"), F.first("_size").alias("_size"),
    ).withColumns({
        "_failed": F.col("_good_before").isNotNull(),
        "_at_start": F.col("_min_seq") == 1,
        "_at_end": F.col("_max_seq") == F.col("_size"),
    })
    # Range bounds come from a sample: the two parts below must see the same buckets, so the
    # pieces (runs and buckets, not events) are computed once.
    pieces = cut_lineage(pieces)
    touches = F.col("_at_start") | F.col("_at_end")
    interior = pieces.where(F.col("_failed") & ~touches)
    # Rank of each non-empty bucket, over at most three rows per bucket.
    edge = pieces.where(~F.col("_failed") | touches).withColumn(
        "_brank", F.dense_rank().over(Window.orderBy("_bucket"))).where("_failed")
    we = Window.orderBy("_brank", "_first")
    prev_end = F.lag("_at_end").over(we)
    prev_rank = F.lag("_brank").over(we)
    cont = F.coalesce(prev_end & F.col("_at_start") & (prev_rank == F.col("_brank") - 1), F.lit(False))
    edge = edge.withColumn("_new", F.when(cont, 0).otherwise(1))
    edge = edge.withColumn("_chain", F.sum("_new").over(we.rowsBetween(Window.unboundedPreceding, 0)))
    stitched = edge.groupBy("_chain").agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("n_events").cast("bigint").alias("n_events"))
    runs = interior.select("_first", "_last", "n_events").unionByName(stitched.select("_first", "_last", "n_events"))
    ids = [F.col("_first._tie").alias("first_id"), F.col("_last._tie").alias("last_id")] if with_ids else []
    return runs.select(F.col("_first._ts").alias("run_start"), F.col("_last._ts").alias("run_end"), "n_events", *ids)


def error_runs(log: DataFrame, n: int = ALERT_ERROR_RUN) -> DataFrame:
    """Runs of more than ``n`` consecutive failed requests."""
    tagged = log.withColumn("failed", F.col("status") >= 500)
    return failure_islands(tagged).where(F.col("n_events") > n)


def outages(log: DataFrame, minutes: int = ALERT_OUTAGE_MINUTES) -> DataFrame:
    """Failure runs lasting more than ``minutes`` (first to last
    failed event)."""
    tagged = log.withColumn("failed", F.col("status") >= 500)
    runs = failure_islands(tagged)
    dur = F.unix_micros(F.col("run_end").cast("timestamp")) - F.unix_micros(F.col("run_start").cast("timestamp"))
    return runs.withColumn("duration_s", dur / 1e6).where(F.col("duration_s") > minutes * 60)
