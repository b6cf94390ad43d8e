"""Rolling-origin backtests (M13, H6): the recursive forecast as it would have been made on
many past days at once, scored by how far ahead each day lay.

The rows of a series that some origin reads are brought together once (one shuffle; a series has
at most one row per day). From these sorted rows each origin takes the 30 rows up to it as history and the
days after it as conditions and actuals, so one (series, origin) is a row of the
forecaster's state, and the seven scoring steps run over all of them together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlake.functions import items as it
from demandlake.functions import metrics as M
from demandlake.plans import forecast as fc
from demandlake.schema import HISTORY_ROWS, HORIZON_BANDS, HORIZON_DAYS, SERIES_KEYS

_ROW = [*fc.HIST_STRUCT, "price", "shelf_life_hours", "weather_condition", "holiday_flag"]


def weekly_origins(history: DataFrame, count: int) -> Column:
    """Array of ``count`` days, a week apart; the last leaves a whole horizon of actual days."""
    last = history.agg(F.max("date")).scalar()
    return F.array(*[F.date_sub(last, k * HORIZON_DAYS) for k in range(1, count + 1)])


def near_rows(history: DataFrame, origins: Column, horizon: int = HORIZON_DAYS) -> DataFrame:
    """The rows that an origin reads: of a series the days after the oldest origin, up to the end of the last
    horizon, and the ``HISTORY_ROWS`` rows before them, however long the series is."""
    newest_first = Window.partitionBy(*SERIES_KEYS).orderBy(*[F.col(c).desc() for c in _ROW]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rows = history.where(F.col("date") <= F.date_add(F.array_max(origins), horizon)).select(
        *dict.fromkeys([*SERIES_KEYS, *_ROW]))
    older = F.count_if(F.col("date") <= F.array_min(origins)).over(newest_first)
    return rows.withColumn("_older", older).where(F.col("_older") <= HISTORY_ROWS).drop("_older")


def origin_states(history: DataFrame, origins: Column, horizon: int = HORIZON_DAYS) -> DataFrame:
    """One row per series and origin that has a history row up to the origin and an actual
    day after it: the columns of a week request, ``hist``, ``actuals`` (date, demand) and the
    forecaster's flags. Weather and holidays are those of the days, 'Clear' and 0 for days
    without a row."""
    near = near_rows(history, origins, horizon)
    series = near.groupBy(*SERIES_KEYS).agg(F.array_sort(F.collect_list(F.struct(*_ROW))).alias("rows"))
    at = series.withColumn("origin", F.explode(origins))
    at = at.withColumn("past", F.filter("rows", lambda r: r["date"] <= F.col("origin"))).withColumn(
        "future", F.filter("rows", lambda r: (r["date"] > F.col("origin")) & (
            r["date"] <= F.date_add("origin", horizon))))
    at = at.where((F.size("past") > 0) & (F.size("future") > 0))
    last = F.try_element_at("past", F.lit(-1))

    def on_day(k: Column, name: str, default: Column) -> Column:
        found = F.filter("future", lambda r: r["date"] == F.date_add("origin", k + 1))
        return F.coalesce(F.get(found, F.lit(0))[name], default)

    days = F.sequence(F.lit(0), F.lit(HORIZON_DAYS - 1))
    return at.select(
        *SERIES_KEYS, "origin", last["price"].alias("price"), last["shelf_life_hours"].alias("shelf_life_hours"),
        F.date_format(F.date_add("origin", 1), "yyyy-MM-dd").alias("starting_date"),
        F.transform(days, lambda k: on_day(k, "weather_condition", F.lit("Clear"))).alias("weather_forecast"),
        F.transform(days, lambda k: on_day(k, "holiday_flag", F.lit(0)).cast("int")).alias("holiday_flags"),
        F.transform(fc.arr_tail(F.col("past"), HISTORY_ROWS),
                    lambda r: F.struct(*[r[c].alias(c) for c in fc.HIST_STRUCT])).alias("hist"),
        F.transform("future", lambda r: F.struct(r["date"].alias("date"), r["customer_demand"].alias("demand"))).alias("actuals"),
        F.lit(True).alias("has_series"), (~it.is_known_item("item_name")).alias("is_new_item"),
        (F.datediff("origin", last["date"]) + 1).alias("stale_days"))


def backtest(model, history: DataFrame, origins: Column, horizon: int = HORIZON_DAYS, checkpoint: bool = True,
             states: DataFrame | None = None) -> DataFrame:
    """(business_type, item_name, origin, day_number, date, y_true, y_pred) for every forecast day
    that has an actual. ``states`` are the ``origin_states`` of the arguments, if several models share them."""
    if not 1 <= horizon <= HORIZON_DAYS:
        raise ValueError(f"horizon must be 1 to {HORIZON_DAYS} days")
    states = states if states is not None else origin_states(history, origins, horizon)
    done = fc.forecast_state(model, states, horizon, checkpoint)
    rows = done.select(*SERIES_KEYS, "origin", "preds", F.explode("actuals").alias("a"))
    ahead = F.datediff(F.col("a.date"), F.col("origin"))
    return rows.select(*SERIES_KEYS, "origin", ahead.alias("day_number"), F.col("a.date").alias("date"),
                       F.col("a.demand").cast("double").alias("y_true"), F.get("preds", ahead - 1).alias("y_pred"))


def score_by_horizon(scored: DataFrame) -> DataFrame:
    """(band, business_type, mae, mape, rmse, r2, n_predictions, n_excluded) per band of days ahead,
    for each business type and for 'All'."""
    band = F.lit(None).cast("string")
    for name, (first, last) in HORIZON_BANDS.items():
        band = F.when(F.col("day_number").between(first, last), name).otherwise(band)
    sums = scored.withColumn("band", band).rollup("band", "business_type").agg(*M.metric_columns("y_true", "y_pred"))
    return sums.where(F.col("band").isNotNull()).withColumn(
        "business_type", F.coalesce("business_type", F.lit("All")))
