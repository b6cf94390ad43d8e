"""Series windows on hot series (W1-W4 over raw rows).

A window over a series is one task, so a series that holds a third of all rows is one
long task. Here the rows are cut into size-balanced ranges of (series, order); a range
that begins inside a series gets the last ``halo`` rows before it as well, and windows
run inside (range, series). Lags and trailing frames of up to ``halo`` rows see what
they would see in the whole series, and one series runs in many tasks.

What is exchanged between ranges is small: of each range its first row and the last
``halo`` rows of its last series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlake.schema import SERIES_KEYS
from demandlake.session import work_dir

RANGE, HALO, PLACE = "_range", "_halo", "_place"


def split_windows(df: DataFrame, columns: Callable[[list[str], str], dict[str, Column]], order: Sequence[str],
                  keys: Sequence[str] = SERIES_KEYS, halo: int = 30, n_ranges: int | None = None) -> DataFrame:
    """``df`` with the window columns ``columns(keys, order column)``, whose frames reach at most ``halo`` rows
    back and none ahead. Rows of equal ``order`` must be told apart by it, or their places are arbitrary
    (as in any window). Column names beginning with ``_range``, ``_halo`` and ``_place`` are taken."""
    spark, keys = df.sparkSession, list(keys)
    n = n_ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    path = work_dir(spark, "ranges")
    cut = df.withColumn(PLACE, F.struct(*order)).repartitionByRange(n, *keys, PLACE).withColumn(RANGE, F.spark_partition_id())
    cut.write.parquet(path)  # the ranges are read three times and must stay as they are
    rows = spark.read.schema(cut.schema).parquet(path)
    place = F.struct(*keys, PLACE)
    ends = rows.groupBy(RANGE).agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    at_end = F.lit(True)
    for k in keys:
        at_end = at_end & F.col(k).eqNullSafe(F.col(f"_last.{k}"))
    # the last rows of each range's last series: a window group limit, so a range sends at most ``halo`` rows on
    back = Window.partitionBy(RANGE).orderBy(F.col(PLACE).desc())
    tails = rows.join(ends.select(RANGE, "_last"), RANGE).where(at_end).withColumn("_n", F.row_number().over(back)).where(
        F.col("_n") <= halo).drop("_n", "_last").withColumn("_tail", F.lit(True))
    heads = rows.join(ends.select(RANGE, "_first"), RANGE).where(place.eqNullSafe(F.col("_first"))).drop("_first").withColumn(
        "_tail", F.lit(False))
    whole = F.struct(*[F.col(c) for c in df.columns], PLACE)
    near = Window.partitionBy(*keys).orderBy(RANGE, PLACE, F.col("_tail").desc())
    edge = tails.unionByName(heads).withColumn("_before", F.collect_list(F.when(F.col("_tail"), F.struct(
        F.col(RANGE).alias("r"), whole.alias("row")))).over(near.rowsBetween(-2 * halo, -1)))
    mine = F.filter("_before", lambda x: x["r"] < F.col(RANGE))
    start = F.greatest(F.size(mine) - halo, F.lit(0)) + 1
    halos = edge.where(~F.col("_tail")).dropDuplicates([RANGE]).select(
        F.explode(F.slice(mine, start, halo)).alias("x"), F.col(RANGE)).select("x.row.*", RANGE, F.lit(True).alias(HALO))
    both = rows.withColumn(HALO, F.lit(False)).unionByName(halos)
    return both.withColumns(columns([RANGE, *keys], PLACE)).where(~F.col(HALO)).drop(HALO, RANGE, PLACE)
