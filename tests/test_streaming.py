"""Structured Streaming: late rows beyond the watermark are dropped, on-time
rows update their windows, and a batch written twice is not duplicated."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from demandlake.operators.quality import upload_rules
from demandlake.streaming import jobs

SCHEMA = "business_type string, ts timestamp, y_true double, y_pred double"


def test_watermark_drops_late_rows(spark):
    base = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    src = os.path.join(base, "incoming")
    day = dt.datetime(2025, 6, 1)
    first = [("Cafe", day + dt.timedelta(days=i), 10.0, 8.0) for i in range(10)]
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    # Next file: an on-time row that moves the watermark to 06-09; the file
    # after it: a row for 06-02, far behind. Spark judges lateness against
    # the previous batch's watermark, so the late row is in a later file.
    spark.createDataFrame([("Cafe", day + dt.timedelta(days=10), 20.0, 10.0)], SCHEMA).coalesce(1) \
        .write.mode("append").parquet(src)
    spark.createDataFrame([("Cafe", day + dt.timedelta(days=1), 100.0, 0.0)], SCHEMA).coalesce(1) \
        .write.mode("append").parquet(src)
    sdf = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    scored = jobs.stream_accuracy(sdf)
    q = jobs.run_to_table(scored, os.path.join(base, "out"), os.path.join(base, "ckpt"))
    q.awaitTermination()
    got = {r.window_start.date(): (r.n_predictions, r.mae)
           for r in jobs.read_latest(spark, os.path.join(base, "out"), ["business_type", "window_start"],
                                     scored.schema).collect()}
    assert got[dt.date(2025, 6, 2)] == (1, 2.0)  # the late row did not count
    assert got[dt.date(2025, 6, 11)] == (1, 10.0)
    assert len(got) == 11


def test_ingest_batch_rewrite_is_idempotent(spark):
    base = tempfile.mkdtemp(prefix="ingest-", dir="/tmp")
    df = spark.createDataFrame([("2025-06-01", "Latte", 3, 5), ("bad", "Latte", -1, 5)],
                               "date string, item_name string, quantity_sold bigint, quantity_available bigint")
    for _ in range(2):  # the same batch id written twice (a replay)
        jobs._write_batch(df, 0, os.path.join(base, "t"))
    back = spark.read.parquet(os.path.join(base, "t"))
    assert back.count() == 2 and back.where(F.col("_batch") == 0).count() == 2


def test_ingest_of_clean_input_leaves_a_readable_quarantine(spark):
    base = tempfile.mkdtemp(prefix="clean-", dir="/tmp")
    ddl = "date string, item_name string, quantity_sold bigint, quantity_available bigint"
    spark.createDataFrame([("2025-06-01", "Latte", 3, 5)], ddl).write.parquet(os.path.join(base, "in"))
    sdf = spark.readStream.schema(ddl).parquet(os.path.join(base, "in"))
    jobs.stream_ingest(sdf, os.path.join(base, "h"), os.path.join(base, "q"), os.path.join(base, "c"),
                       upload_rules).awaitTermination()
    good, bad = jobs.ingest_schemas(sdf)
    assert spark.read.schema(good).parquet(os.path.join(base, "h")).count() == 1
    assert spark.read.schema(bad).parquet(os.path.join(base, "q")).count() == 0


def test_risk_keeps_plans_without_a_forecast(spark):
    plans = spark.createDataFrame([("Cafe", "Latte", "2025-06-01", 60), ("Cafe", "Bun", "2025-06-01", 10)],
                                  "business_type string, item_name string, date string, planned_quantity bigint")
    known = spark.createDataFrame([("Cafe", "Latte", "2025-06-01", 40)],
                                  "business_type string, item_name string, date string, predicted_demand bigint")
    got = {r.item_name: (r.risk_level, r.no_forecast) for r in jobs.stream_risk(plans, known).collect()}
    assert got == {"Latte": ("HIGH", False), "Bun": (None, True)}
