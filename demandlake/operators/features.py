"""Feature operators (P1-P13, W1-W4): DataFrame -> DataFrame.

All series windows share one spec, partition (business_type, item_name)
ordered by date, so the whole feature build is one exchange, one sort and
one Window node in the physical plan. A series holds one row per day of the
daily sales table, so a window partition is bounded by the calendar, not by
the data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlake.functions import calendar as cal
from demandlake.functions import items
from demandlake.schema import FEATURE_COLS, ROLLING_MEANS, ROLLING_STDS, SERIES_KEYS


def series_window(keys: Sequence[str] = SERIES_KEYS, order: str = "date"):
    return Window.partitionBy(*keys).orderBy(order)


def add_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """P1 + P2."""
    return df.withColumns(cal.calendar_columns(date))


def add_weather(df: DataFrame, weather: str = "weather_condition") -> DataFrame:
    """P3."""
    return df.withColumn("is_rainy", cal.is_rainy(weather))


def add_cyclical(df: DataFrame, dow: str = "day_of_week", month: str = "month") -> DataFrame:
    """P4."""
    return df.withColumns(cal.cyclical_columns(dow, month))


def add_interactions(df: DataFrame) -> DataFrame:
    """P5."""
    return df.withColumns(cal.interaction_columns())


def enrich_items(
    df: DataFrame,
    dim: DataFrame | None = None,
    keywords: bool = True,
    name: str = "item_name",
) -> DataFrame:
    """P6 + P7: category and preparation_complexity per row.

    Without ``dim`` the fixed known-item dictionary is applied as a literal
    map (no join). With a ``dim`` (item_name, category,
    preparation_complexity) table, a left join is used; the planner broadcasts
    it when its size in bytes allows."""
    if dim is None:
        item = items.item_struct(name, "price", "shelf_life_hours", keywords)
        return df.withColumn("_item", item).withColumns(
            {"category": F.col("_item.category"), "preparation_complexity": F.col("_item.complexity")}).drop("_item")

    d = dim.select(
        F.col("item_name").alias("_dim_name"),
        F.col("category").alias("_dim_cat"),
        F.col("preparation_complexity").cast("int").alias("_dim_cx"),
    )
    g_cat, g_cx = items.guess_item(name, "price", "shelf_life_hours", keywords)
    joined = df.join(d, F.col(name) == F.col("_dim_name"), "left")
    return joined.withColumns(
        {
            "category": F.coalesce("_dim_cat", g_cat),
            "preparation_complexity": F.coalesce("_dim_cx", g_cx),
        }
    ).drop("_dim_name", "_dim_cat", "_dim_cx")


def encode_labels(df: DataFrame, strict: bool = True) -> DataFrame:
    """Alphabetical label codes of category and business type."""
    return df.withColumns(
        {
            "category_encoded": items.encode_category("category", strict),
            "business_encoded": items.encode_business("business_type", strict),
        }
    )


def fill_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Numeric nulls -> 0 (strings are left alone)."""
    return df.fillna(0, subset=list(cols) if cols else None)


def derive_sold_waste(
    df: DataFrame, demand: str = "customer_demand", available: str = "quantity_available"
) -> DataFrame:
    """P10: sold = min(demand, available); waste = max(0, available - sold)."""
    sold = F.least(F.col(demand), F.col(available))
    return df.withColumns(
        {
            "quantity_sold": sold.cast("bigint"),
            "waste_quantity": F.greatest(F.col(available) - sold, F.lit(0)).cast("bigint"),
        }
    )


def add_money(df: DataFrame) -> DataFrame:
    """revenue = sold x price; waste_value = waste x price."""
    return df.withColumns(
        {
            "revenue": F.col("quantity_sold") * F.col("price"),
            "waste_value": F.col("waste_quantity") * F.col("price"),
        }
    )


def waste_pct(waste: str = "waste_quantity", available: str = "quantity_available") -> Column:
    """Waste / available x 100, missing (0/0 or x/0) -> 0."""
    return F.coalesce(
        F.try_divide(F.col(waste).cast("double"), F.col(available).cast("double")) * 100.0,
        F.lit(0.0),
    )


def add_waste_pct(df: DataFrame) -> DataFrame:
    return df.withColumn("waste_pct", waste_pct())


def lag_columns(keys: Sequence[str] = SERIES_KEYS, order: str = "date") -> dict[str, Column]:
    """W1 + W2: previous-row values; prev_week is 7 rows back (not 7 days)."""
    w = series_window(keys, order)
    return {
        "prev_day_demand": F.lag("customer_demand", 1).over(w),
        "prev_day_sold": F.lag("quantity_sold", 1).over(w),
        "prev_day_waste": F.lag("waste_quantity", 1).over(w),
        "prev_week_demand": F.lag("customer_demand", 7).over(w),
    }


def rolling_columns(
    means: Sequence[int] = ROLLING_MEANS,
    stds: Sequence[int] = ROLLING_STDS,
    include_current: bool = True,
    keys: Sequence[str] = SERIES_KEYS,
    order: str = "date",
    value: str = "customer_demand",
) -> dict[str, Column]:
    """W3 + W4: trailing means (min 1 row) and sample stds over n rows.

    ``include_current=True`` matches the training features of the reference
    (the frame holds the label of the same row); ``False`` uses the n rows
    before the current one only, which is what serving can know."""
    w = series_window(keys, order)

    def frame(n: int):
        return w.rowsBetween(-(n - 1), 0) if include_current else w.rowsBetween(-n, -1)

    out: dict[str, Column] = {}
    for n in means:
        out[f"rolling_{n}day_demand"] = F.avg(value).over(frame(n))
    for n in stds:
        out[f"rolling_{n}day_std"] = F.stddev_samp(value).over(frame(n))
    return out


def add_lags(df: DataFrame) -> DataFrame:
    return df.withColumns(lag_columns())


def add_rolling(df: DataFrame, include_current: bool = True, **kw) -> DataFrame:
    return df.withColumns(rolling_columns(include_current=include_current, **kw))


FILLED = "_filled"
#: prefix of the rolling columns over past rows only, beside those with the current row
PAST = "past_"


def densify(df: DataFrame, keys: Sequence[str] = SERIES_KEYS, date: str = "date") -> DataFrame:
    """Insert every missing calendar day inside each series' own date range
    (A7 per series) as a row with null measures, flagged ``_filled``.

    Lags and rolling frames over the dense table count days, not rows
    ("previous week" = 7 days earlier). The calendar holds one row per
    series-day, so it is bounded by the date range."""
    from demandlake.operators.eda import gap_days, missing_dates

    keys = list(keys)
    if not isinstance(df.schema[date].dataType, T.DateType):
        gaps = missing_dates(df.select(*keys, date), by=keys, date=date).withColumn(FILLED, F.lit(True))
        return df.withColumn(FILLED, F.lit(False)).unionByName(gaps, allowMissingColumns=True)
    # a row is followed by the days up to the next row of its series: one exchange, which the windows over
    # the dense table need as well, and no join
    following = F.lead(date).over(series_window(keys, date))
    day = F.struct(F.col(date).alias("day"), F.lit(False).alias("filled"))
    gaps = F.coalesce(F.transform(gap_days(date, following, keys), lambda d: F.struct(d.alias("day"), F.lit(True).alias("filled"))),
                      F.array().cast("array<struct<day:date,filled:boolean>>"))
    rows = df.withColumn("_gaps", F.concat(F.array(day), gaps)).withColumn("_day", F.explode("_gaps"))
    filled = F.col("_day.filled")
    kept = [F.col("_day.day").alias(c) if c == date else F.col(c) if c in keys else F.when(~filled, F.col(c)).alias(c)
            for c in df.columns]
    return rows.select(*kept, filled.alias(FILLED))


def build_features(
    sales: DataFrame,
    include_current: bool | None = True,
    dim: DataFrame | None = None,
    keywords: bool = True,
    strict: bool = True,
    densify_days: bool = False,
) -> DataFrame:
    """Full feature table: raw 11 + calendar + weather + item + lags +
    rolling + interactions + cyclical, numeric nulls filled with 0.

    ``densify_days=True`` computes lags and rolling stats over the calendar
    (gap days count as missing values) instead of over rows; only the
    original rows are returned. ``include_current=None`` gives the rolling columns of both
    kinds in one pass; ``rolling_kind`` selects one of them."""
    df = densify(sales) if densify_days else sales
    rolling = rolling_columns(include_current=include_current is not False)
    if include_current is None:
        rolling |= {PAST + name: c for name, c in rolling_columns(include_current=False).items()}
    df = df.withColumns({**lag_columns(), **rolling})
    if densify_days:
        df = df.where(~F.col(FILLED)).drop(FILLED)
    df = add_calendar(df)
    df = add_weather(df)
    df = enrich_items(df, dim=dim, keywords=keywords)
    df = encode_labels(df, strict=strict)
    df = add_interactions(df)
    df = add_cyclical(df)
    return fill_missing(df)


def past_columns(both: DataFrame) -> list[str]:
    return [c for c in both.columns if c.startswith(PAST)]


def rolling_kind(both: DataFrame, include_current: bool) -> DataFrame:
    """The features with one kind of rolling columns, of ``build_features(include_current=None)``."""
    past = past_columns(both)
    if include_current:
        return both.drop(*past)
    return both.drop(*[c.removeprefix(PAST) for c in past]).withColumnsRenamed({c: c.removeprefix(PAST) for c in past})


def feature_frame(features: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The ordered 34 feature columns (as double) plus ``extra``."""
    return features.select(*extra, *[F.col(c).cast("double").alias(c) for c in FEATURE_COLS])
