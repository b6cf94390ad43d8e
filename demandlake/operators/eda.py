"""Exploratory aggregates (A1-A16), each one DataFrame -> DataFrame.

Every aggregate is a single grouped ``agg`` (partial + final hash
aggregation: hot groups are combined map-side before the shuffle). Results
are small: one row per group, per column, or per histogram bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlake.functions import calendar as cal
from demandlake.operators.features import waste_pct
from demandlake.session import cut_lineage

CORR_COLS = [
    "price", "shelf_life_hours", "quantity_available",
    "quantity_sold", "customer_demand", "waste_quantity",
]
DESCRIBE_COLS = [
    "price", "shelf_life_hours", "quantity_available", "quantity_sold",
    "customer_demand", "waste_quantity", "holiday_flag",
]


def _unpivot(row: DataFrame, names: Sequence[str], value_cols: Sequence[Sequence[str]],
             out: Sequence[str]) -> DataFrame:
    """Turn a one-row frame with per-name columns into long form via
    ``stack`` (JVM-side, no driver round trip)."""
    parts = []
    for name, cols in zip(names, value_cols):
        parts.append(f"'{name}'")
        parts.extend(f"`{c}`" for c in cols)
    expr = f"stack({len(names)}, {', '.join(parts)}) as ({', '.join(out)})"
    return row.selectExpr(expr)


def overview_columns(df: DataFrame) -> DataFrame:
    """A1: (column, dtype, non_null) per column."""
    aggs = [F.count(F.col(f"`{c}`")).cast("bigint").alias(f"nn_{i}") for i, c in enumerate(df.columns)]
    dtypes = [F.lit(t).alias(f"dt_{i}") for i, (_, t) in enumerate(df.dtypes)]
    one = df.agg(*aggs).select("*", *dtypes)
    return _unpivot(one, df.columns, [[f"dt_{i}", f"nn_{i}"] for i in range(len(df.columns))],
                    ["column", "dtype", "non_null"])


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, q0, q1, ...): exact quantiles with linear interpolation (as pandas), nulls left out.

    Rows are first counted per (column, value); the counts are range-partitioned by value, each
    partition gets its offset from a table of one row per partition and column, and only the two values
    around each wanted rank remain. No task holds the values of a whole column."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols]))
    counts = df.select(values.alias("x")).select("x.*").where("v is not null").groupBy("column", "v").agg(
        F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts.repartitionByRange("column", "v").withColumn("part", F.spark_partition_id()))
    sums = counts.groupBy("column", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("column").orderBy("part")
    sums = sums.select("column", "part", (F.sum("n").over(before) - F.col("n")).alias("offset"),
                       F.sum("n").over(Window.partitionBy("column")).alias("total"))
    run = F.sum("n").over(Window.partitionBy("column", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("run", run).join(sums, ["column", "part"])
    last = F.col("offset") + F.col("run") - 1  # ranks from first to last hold this value
    first = last - F.col("n") + 1
    aggs = []
    for i, q in enumerate(probs):
        at = (F.col("total") - 1) * F.lit(float(q))
        pick = lambda r: F.max(F.when((first <= r) & (last >= r), F.col("v")))
        aggs += [pick(F.floor(at)).alias(f"lo{i}"), pick(F.ceil(at)).alias(f"hi{i}"),
                 F.max(at - F.floor(at)).alias(f"w{i}")]
    out = ranked.groupBy("column").agg(*aggs)
    return out.select("column", *[(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"w{i}")).alias(f"q{i}")
                                  for i in range(len(probs))])


def describe(df: DataFrame, cols: Sequence[str] = DESCRIBE_COLS, exact: bool = True) -> DataFrame:
    """A2: count, mean, sample std, min, quartiles, max per column.

    ``exact=True`` finds the quartiles by ``exact_quantiles``; ``exact=False`` uses
    ``percentile_approx`` in the same pass as the rest."""
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs += [
            F.count(v).cast("bigint").alias(f"n_{i}"),
            F.avg(v).alias(f"mean_{i}"),
            F.stddev_samp(v).alias(f"std_{i}"),
            F.min(v).alias(f"min_{i}"),
            F.max(v).alias(f"max_{i}"),
        ]
        if not exact:
            aggs.append(F.percentile_approx(v, [0.25, 0.5, 0.75], 10000).cast("array<double>").alias(f"a_{i}"))
    names = ["count", "mean", "std", "min", "max"]
    one = df.agg(*aggs)
    if exact:
        rows = _unpivot(one, list(cols), [[f"{k}_{i}" for k in ("n", "mean", "std", "min", "max")] for i in range(len(cols))],
                        ["column", *names])
        rows = rows.join(exact_quantiles(df, cols), "column", "left")
    else:
        one = one.select("*", *[F.col(f"a_{i}")[j].alias(f"q{j}_{i}") for i in range(len(cols)) for j in range(3)])
        rows = _unpivot(one, list(cols), [[f"{k}_{i}" for k in ("n", "mean", "std", "min", "max", "q0", "q1", "q2")]
                                          for i in range(len(cols))], ["column", *names, "q0", "q1", "q2"])
    return rows.select("column", "count", "mean", "std", "min", F.col("q0").alias("p25"), F.col("q1").alias("p50"),
                       F.col("q2").alias("p75"), "max")


def count_by(df: DataFrame, by: str | Sequence[str] = "business_type") -> DataFrame:
    """A3: row count per group, largest first."""
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")).orderBy(F.desc("n_rows"), *by)


def distinct_items(df: DataFrame, approx: bool = False) -> DataFrame:
    """A4: distinct items per business (``approx`` uses HyperLogLog++)."""
    n = F.approx_count_distinct("item_name") if approx else F.countDistinct("item_name")
    return df.groupBy("business_type").agg(n.cast("bigint").alias("n_items"))


def null_counts(df: DataFrame) -> DataFrame:
    """A5: (column, n_null) per column, one pass."""
    aggs = [F.count_if(F.col(f"`{c}`").isNull()).cast("bigint").alias(f"z_{i}") for i, c in enumerate(df.columns)]
    return _unpivot(df.agg(*aggs), df.columns, [[f"z_{i}"] for i in range(len(df.columns))],
                    ["column", "n_null"])


def violations(df: DataFrame) -> DataFrame:
    """Rule-violation counts in one pass."""
    c = F.col
    return df.agg(
        F.count_if(c("quantity_sold") < 0).cast("bigint").alias("negative_sold"),
        F.count_if(c("quantity_available") < 0).cast("bigint").alias("negative_available"),
        F.count_if(c("quantity_sold") > c("quantity_available")).cast("bigint").alias("sold_gt_available"),
        F.count_if(c("quantity_sold") > c("customer_demand")).cast("bigint").alias("sold_gt_demand"),
    )


def gap_days(date: str, following: Column, by: Sequence[str]) -> Column:
    """Array of the days after ``date`` and before ``following``, the next day of the group; null if there are none
    or ``following`` is ``date`` itself. In a group with a null key no day counts as present."""
    known = F.lit(True)
    for k in by:
        known = known & F.col(k).isNotNull()
    first = F.when(known, F.date_add(date, 1)).otherwise(F.col(date))
    last = F.coalesce(F.date_sub(following, 1), F.when(~known, F.col(date)))
    return F.when(first <= last, F.sequence(first, last, F.expr("interval 1 day")))


def missing_dates(df: DataFrame, by: Sequence[str] | None = None, date: str = "date") -> DataFrame:
    """Calendar days between min and max date with no row.

    Whole table by default, or per group ``by``. The calendar has one row
    per day (bounded by the date range), and the anti join is on
    (group, date) with only the distinct present days on the right. Groups are gone through by
    their distinct days, each of which gives the days up to the next, so the work is dealt like the
    days and not like the groups, of which one task can hold thousands."""
    by = list(by or [])
    if by and isinstance(df.schema[date].dataType, T.DateType):
        present = df.select(*by, date).distinct()
        following = F.lead(date).over(Window.partitionBy(*by).orderBy(date))
        gaps = present.withColumn("_days", gap_days(date, following, by))
        return gaps.select(*by, F.explode("_days").alias(date))
    rng = df.groupBy(*by).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    calendar = rng.select(*by, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 day"))).alias(date))
    present = df.select(*by, date).distinct()
    return calendar.join(present, on=[*by, date], how="left_anti")


def histogram(df: DataFrame, col: str, by: str = "business_type", bins: int = 30) -> DataFrame:
    """Equal-width histogram per group with all ``bins`` bins (empty
    ones included); the last bin is closed. A constant group is widened to
    value +- 0.5, as numpy does."""
    v = F.col(col).cast("double")
    rng = df.groupBy(by).agg(F.min(v).alias("_mn"), F.max(v).alias("_mx"))
    rng = rng.select(
        by,
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_lo"),
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_hi"),
    )
    # One row per group: as a map in a scalar subquery it reaches the fact rows without a join,
    # so they are binned where they are, whatever the planner knows of the table's size.
    ranges = rng.where(F.col(by).isNotNull()).agg(
        F.map_from_entries(F.collect_list(F.struct(by, F.struct("_lo", "_hi"))))).scalar()
    tagged = df.select(by, v.alias("_v")).where(F.col("_v").isNotNull()).withColumn(
        "_range", F.try_element_at(ranges, F.col(by))).select(by, "_v", "_range.*").where("_lo is not null")
    b = F.least(
        F.floor(F.lit(float(bins)) * (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))) + 1,
        F.lit(bins),
    ).cast("int")
    counts = tagged.groupBy(by, b.alias("bin")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    grid = rng.select(by, "_lo", "_hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return grid.join(counts, [by, "bin"], "left").select(
        by,
        F.col("bin").cast("int").alias("bin"),
        (F.col("_lo") + (F.col("bin") - 1) * width).alias("lower"),
        (F.col("_lo") + F.col("bin") * width).alias("upper"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def mean_by_weekday(df: DataFrame) -> DataFrame:
    """Mean demand by weekday (Mon = 0) per business."""
    return df.groupBy("business_type", cal.day_of_week("date").cast("bigint").alias("day_of_week")).agg(
        F.avg("customer_demand").alias("mean_demand")
    )


def weather_impact(df: DataFrame, digits: int = 2) -> DataFrame:
    """A10: mean/std demand and mean waste per (business, weather)."""
    return df.groupBy("business_type", "weather_condition").agg(
        F.round(F.avg("customer_demand"), digits).alias("mean_demand"),
        F.round(F.stddev_samp("customer_demand"), digits).alias("std_demand"),
        F.round(F.avg("waste_quantity"), digits).alias("mean_waste"),
    )


def holiday_impact(df: DataFrame, digits: int = 2) -> DataFrame:
    """Mean demand and waste per (business, holiday flag)."""
    return df.groupBy("business_type", "holiday_flag").agg(
        F.round(F.avg("customer_demand"), digits).alias("mean_demand"),
        F.round(F.avg("waste_quantity"), digits).alias("mean_waste"),
    )


def weekend_impact(df: DataFrame, digits: int = 2) -> DataFrame:
    """Mean demand, weekend vs weekday, per business."""
    we = (cal.day_of_week("date") >= 5).cast("int").alias("is_weekend")
    return df.groupBy("business_type", we).agg(F.round(F.avg("customer_demand"), digits).alias("mean_demand"))


def daily_totals(df: DataFrame) -> DataFrame:
    """Total demand per business and day."""
    return df.groupBy("business_type", "date").agg(F.sum("customer_demand").cast("bigint").alias("total_demand"))


def correlation(df: DataFrame, cols: Sequence[str] = CORR_COLS) -> DataFrame:
    """Pearson correlation matrix in long form (col_a, col_b, r),
    pairwise-complete, null for a constant column. One aggregation pass
    computes every pair; ``try_divide`` keeps constants from failing under
    ANSI mode."""
    cols = list(cols)
    aggs, names, vals = [], [], []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i:
                continue
            x, y = F.col(a).cast("double"), F.col(b).cast("double")
            both = x.isNotNull() & y.isNotNull()
            xa, yb = F.when(both, x), F.when(both, y)
            aggs.append(
                F.try_divide(F.covar_pop(xa, yb), F.stddev_pop(xa) * F.stddev_pop(yb)).alias(f"r_{i}_{j}")
            )
    one = df.agg(*aggs)
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            names.append(f"{a}|{b}")
            vals.append([f"r_{min(i, j)}_{max(i, j)}"])
    long = _unpivot(one, names, vals, ["pair", "r"])
    return long.select(
        F.split("pair", r"\|")[0].alias("col_a"),
        F.split("pair", r"\|")[1].alias("col_b"),
        "r",
    )


def waste_pct_by_item(df: DataFrame, digits: int = 2) -> DataFrame:
    """Mean waste % per (business, item), largest first."""
    return (
        df.groupBy("business_type", "item_name")
        .agg(F.round(F.avg(waste_pct()), digits).alias("mean_waste_pct"))
        .orderBy(F.desc("mean_waste_pct"), "business_type", "item_name")
    )


def business_insights(df: DataFrame) -> DataFrame:
    """Units sold, revenue, waste units/value and waste value per
    trading day, per business."""
    agg = df.groupBy("business_type").agg(
        F.sum("quantity_sold").cast("bigint").alias("units_sold"),
        F.sum(F.col("quantity_sold") * F.col("price")).alias("revenue"),
        F.sum("waste_quantity").cast("bigint").alias("waste_units"),
        F.sum(F.col("waste_quantity") * F.col("price")).alias("waste_value"),
        F.countDistinct("date").cast("bigint").alias("n_days"),
    )
    return agg.withColumn("waste_value_per_day", F.col("waste_value") / F.col("n_days"))
