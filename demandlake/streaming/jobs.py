"""Structured Streaming jobs.

- T1 ``stream_ingest``: validated ingest of uploaded sales files; each
  micro-batch is split by the row rules into history and quarantine
  (table rules such as duplicates need whole tables and stay batch jobs).
- T2 ``stream_accuracy``: daily accuracy per business from a stream of
  (ts, actual, predicted) with a watermark; state older than the watermark
  is evicted, and rows older than the previous batch's watermark are
  dropped (Spark judges lateness one batch behind).
- T3 ``stream_risk``: stateless waste-risk scoring of a plan stream joined
  to a static forecast table (stream-static join).

Sinks are file tables written through ``foreachBatch`` into a
``_batch=<id>`` partition with dynamic partition overwrite, so a batch
replayed after a failure (same checkpoint) replaces its own output instead
of duplicating it; readers of update-mode tables take the newest version of
each key.

State is kept in RocksDB (``STATE_STORE``), so that keys take disk and a bounded memory instead of
executor heap; a session that names a state store of its own keeps that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from demandlake.functions import metrics as M
from demandlake.operators.decide import add_waste_risk
from demandlake.operators.quality import split_valid


STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def start(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Start a stream that keeps state with the settings of ``STATE_STORE`` that the session has not made itself.
    A stream copies its session's settings at the start; a checkpoint made with another store stays with that."""
    mine = [k for k in STATE_STORE if spark.conf.get(k, None) is None]
    try:
        for k in mine:
            spark.conf.set(k, STATE_STORE[k])
        return writer.start()
    finally:
        for k in mine:
            spark.conf.unset(k)


def _write_batch(df: DataFrame, batch_id: int, path: str) -> None:
    """Idempotent per-batch write: the batch owns partition ``_batch=id``."""
    (df.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(path))


def stream_ingest(sdf: DataFrame, history: str, quarantine: str, checkpoint: str,
                  rules_fn, available_now: bool = True) -> StreamingQuery:
    """``rules_fn(df) -> rules``; valid rows are appended to
    ``history``, failing rows (with ``reasons``) to ``quarantine``."""

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # two outputs read the same micro-batch
        try:
            good, bad = split_valid(batch, rules_fn(batch), levels=("issue", "error", "reject"))
            _write_batch(good, batch_id, history)
            _write_batch(bad, batch_id, quarantine)
        finally:
            batch.unpersist()

    w = sdf.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def stream_accuracy(sdf: DataFrame, ts: str = "ts", by: Sequence[str] = ("business_type",),
                    y: str = "y_true", p: str = "y_pred", window: str = "1 day",
                    watermark: str = "2 days") -> DataFrame:
    """Windowed accuracy (mae, mape, rmse, r2, n) per group."""
    return (
        sdf.withWatermark(ts, watermark)
        .groupBy(F.window(ts, window).alias("w"), *by)
        .agg(*M.metric_columns(y, p))
        .select(*by, F.col("w.start").alias("window_start"), "mae", "mape", "rmse", "r2", "n_predictions")
    )


def stream_risk(plans: DataFrame, forecasts: DataFrame,
                keys: Sequence[str] = ("business_type", "item_name", "date")) -> DataFrame:
    """Waste risk of each streamed plan against the static forecasts. A plan
    without a forecast stays, with ``no_forecast`` true and no risk."""
    f = forecasts.select(*keys, "predicted_demand", F.lit(False).alias("no_forecast"))
    scored = add_waste_risk(plans.join(f, list(keys), "left"))
    scored = scored.withColumn("no_forecast", F.coalesce("no_forecast", F.lit(True)))
    added = [c for c in scored.columns if c not in plans.columns and c not in ("predicted_demand", "no_forecast")]
    return scored.withColumns({c: F.when(~F.col("no_forecast"), F.col(c)) for c in added})


def run_to_table(sdf: DataFrame, path: str, checkpoint: str, mode: str = "update",
                 available_now: bool = True) -> StreamingQuery:
    """Run a streaming aggregate into a file table with the batch id."""

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, batch_id, path)

    w = sdf.writeStream.outputMode(mode).foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return start(sdf.sparkSession, w)


def ingest_schemas(sdf: DataFrame) -> tuple[T.StructType, T.StructType]:
    """Schemas of the history and quarantine sinks of ``stream_ingest``: readers
    declare them, since a sink that no row has reached holds no file."""
    good = T.StructType(list(sdf.schema.fields))
    return good, T.StructType([*good.fields, T.StructField("reasons", T.ArrayType(T.StringType()))])


def read_latest(spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType) -> DataFrame:
    """Newest version of each key in an update-mode table of ``schema`` (grouped
    max_by, no global sort)."""
    df = spark.read.schema(T.StructType([*schema.fields, T.StructField("_batch", T.LongType())])).parquet(path)
    cols = [c for c in df.columns if c not in keys and c != "_batch"]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), "_batch").alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in cols])
