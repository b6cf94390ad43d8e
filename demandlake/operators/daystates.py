"""Mergeable daily states (A2, A4, A8, A14): summaries of any date range without a scan of the facts.

One row per (business type, day) holds count, sums of first and second powers, least and
largest value and a HyperLogLog sketch of the items; one row per (business type, day,
bucket) holds a histogram with buckets of relative width ``GROWTH``. All of them add up, so a
range of days is a merge of its rows, and a day that is written again replaces its own
rows only. Counts, means, deviations, least and largest are exact; quantiles are within half a bucket
(``QUANTILE_ERROR`` relative); distinct items have the sketch's error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GROWTH = 1.02
QUANTILE_ERROR = GROWTH**0.5 - 1
_SKETCH_LG = 12
BY = "business_type"
_MOMENTS = f"{BY} string, date date, n bigint, total double, squares double, least double, largest double, items binary"
_BUCKETS = f"{BY} string, date date, bucket int, n bigint"


def bucket(v: Column) -> Column:
    """Bucket of a value of at least 0; 0 has a bucket of its own (null)."""
    return F.when(v > 0, F.floor(F.ln(v) / F.ln(F.lit(GROWTH))).cast("int"))


def bucket_value(b: Column) -> Column:
    """The geometric middle of a bucket."""
    return F.coalesce(F.pow(F.lit(GROWTH), b + 0.5), F.lit(0.0))


def write_states(sales: DataFrame, folder: str, value: str = "customer_demand") -> None:
    """Writes the states of all days in ``sales``; days already stored under ``folder`` are replaced."""
    v = F.col(value).cast("double")
    known = sales.where(v.isNotNull())
    moments = known.groupBy(BY, "date").agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.min(v).alias("least"),
        F.max(v).alias("largest"), F.hll_sketch_agg("item_name", _SKETCH_LG).alias("items"))
    buckets = known.groupBy(BY, "date", bucket(v).alias("bucket")).agg(F.count(v).alias("n"))
    for name, df in (("moments", moments), ("buckets", buckets)):
        df.withColumn("day", F.date_format("date", "yyyy-MM-dd")).repartition("day").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{folder}/{name}")


def _days(spark: SparkSession, folder: str, name: str, schema: str, first: str, last: str) -> DataFrame:
    return spark.read.schema(f"{schema}, day string").parquet(f"{folder}/{name}").where(F.col("day").between(first, last))


def range_summary(spark: SparkSession, folder: str, first: str, last: str, probs: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """(business_type, n, mean, std, least, largest, n_items, q0, q1, ...) of the days ``first`` to ``last``
    (yyyy-MM-dd, inclusive; only these days' folders are read)."""
    moments = _days(spark, folder, "moments", _MOMENTS, first, last)
    n, total = F.sum("n"), F.sum("total")
    spread = F.sum("squares") - total * total / n
    sums = moments.groupBy(BY).agg(
        n.alias("n"), (total / n).alias("mean"), F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n - 1))).alias("std"),
        F.min("least").alias("least"), F.max("largest").alias("largest"),
        F.hll_sketch_estimate(F.hll_union_agg("items")).alias("n_items"))
    merged = _days(spark, folder, "buckets", _BUCKETS, first, last).groupBy(BY, "bucket").agg(F.sum("n").alias("n"))
    run = Window.partitionBy(BY).orderBy(F.col("bucket").asc_nulls_first())  # a bounded number of buckets
    merged = merged.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy(BY)))
    place = F.struct(F.col("bucket").isNotNull().alias("some"), F.col("bucket"))
    found = [F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * F.lit(float(q))), place)) for q in probs]
    quantiles = merged.groupBy(BY).agg(*[bucket_value(f["bucket"]).alias(f"q{i}") for i, f in enumerate(found)])
    return sums.join(quantiles, BY)
