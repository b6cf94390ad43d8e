"""Row selection operators: last-n per group (W5-W7), time split (F1/F2),
equality filters (F3), series sort (F4), top-k (F5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_n(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    n: int,
    rank_col: str = "_rank",
    keep_rank: bool = True,
) -> DataFrame:
    """The last ``n`` rows per key by ``order`` (later first; further
    order columns break ties). Spark plans this as a window group limit, so
    each partition keeps at most ``n`` rows per key before the final rank."""
    order = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    out = df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)
    return out if keep_rank else out.drop(rank_col)


def business_tail(history: DataFrame, n: int = 30, business: str = "business_type",
                  date: str = "date", tie: str = "item_name") -> DataFrame:
    """The last ``n`` rows of each business type (by date, then ``tie``
    descending), used when a requested series has no history of its own.

    A business holds many series, so ranking all of its rows in one window
    task would not scale. Instead: (1) count rows per (business, day) - a
    calendar-sized table; (2) a running count over days from the newest
    finds the oldest day still needed; (3) only rows on or after that day
    reach the final ranking window (n rows plus the rows sharing that day)."""
    per_day = history.groupBy(business, date).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(business).orderBy(F.col(date).desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = per_day.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    needed = before.where(F.col("_before") < n).groupBy(business).agg(F.min(date).alias("_from"))

    # ``needed`` has one row per business: as a map in a scalar subquery it reaches the rows without a
    # join, which would deal the whole history over a few business types.
    first = needed.where(F.col(business).isNotNull()).agg(
        F.map_from_entries(F.collect_list(F.struct(business, "_from")))).scalar()
    recent = history.where(F.col(date) >= F.try_element_at(first, F.col(business)))
    wr = Window.partitionBy(business).orderBy(F.col(date).desc(), F.col(tie).desc())
    return recent.withColumn("_brank", F.row_number().over(wr)).where(F.col("_brank") <= n).drop("_brank")


def time_split(df: DataFrame, days: int = 30, date: str = "date",
               require_test: bool = False) -> tuple[DataFrame, DataFrame]:
    """cutoff = max(date) - ``days``; train is date <= cutoff, test is
    later. The cutoff is a scalar subquery (a partial + final max; no
    driver round trip, no join). F2: ``require_test`` raises when the test
    side is empty."""
    cutoff = df.agg(F.date_sub(F.max(date), days)).scalar()
    train = df.where(F.col(date) <= cutoff)
    test = df.where(F.col(date) > cutoff)
    if require_test and test.isEmpty():
        raise ValueError("Not enough data for test split")
    return train, test


def filter_series(df: DataFrame, **equals) -> DataFrame:
    """equality filters, e.g. ``business_type='Cafe'`` (pushed to the
    scan when the column is stored)."""
    cond = F.lit(True)
    for k, v in equals.items():
        if v is not None:
            cond = cond & (F.col(k) == F.lit(v))
    return df.where(cond)


def sort_series(df: DataFrame, keys: Sequence[str] = ("business_type", "item_name"),
                date: str = "date") -> DataFrame:
    """global order by series then date (only needed for output)."""
    return df.orderBy(*keys, date)


def top_k(df: DataFrame, by: str, k: int, tie: str | None = None) -> DataFrame:
    """the ``k`` largest rows by ``by`` (a top-k report; the limit is
    the feature). Spark plans orderBy+limit as TakeOrderedAndProject."""
    order = [F.col(by).desc()] + ([F.col(tie)] if tie else [])
    return df.orderBy(*order).limit(k)
