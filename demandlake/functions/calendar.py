"""Calendar, weather, cyclical and interaction columns (pure Column exprs)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_of_week(date: str | Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(date))


def day_name(date: str | Column) -> Column:
    """Full English day name, e.g. 'Monday'."""
    return F.date_format(_c(date), "EEEE")


def calendar_columns(date: str | Column) -> dict[str, Column]:
    """P1 + P2: calendar fields and day flags, keyed by output name."""
    d = _c(date)
    dow = day_of_week(d)
    return {
        "day_of_week": dow,
        "day_name": day_name(d),
        "month": F.month(d),
        "week_of_year": F.weekofyear(d),
        "day_of_month": F.dayofmonth(d),
        "is_weekend": (dow >= 5).cast("int"),
        "is_monday": (dow == 0).cast("int"),
        "is_friday": (dow == 4).cast("int"),
        "is_saturday": (dow == 5).cast("int"),
        "is_sunday": (dow == 6).cast("int"),
    }


def is_rainy(weather: str | Column) -> Column:
    """1 when weather is 'Rainy'; missing counts as not rainy."""
    return F.coalesce(_c(weather) == F.lit("Rainy"), F.lit(False)).cast("int")


def cyclical_columns(dow: str | Column, month: str | Column) -> dict[str, Column]:
    """sin/cos encodings of weekday (period 7) and month (period 12)."""
    two_pi = 2 * math.pi
    d, m = _c(dow), _c(month)
    return {
        "day_sin": F.sin(F.lit(two_pi) * d / 7),
        "day_cos": F.cos(F.lit(two_pi) * d / 7),
        "month_sin": F.sin(F.lit(two_pi) * m / 12),
        "month_cos": F.cos(F.lit(two_pi) * m / 12),
    }


def interaction_columns(
    is_weekend: str | Column = "is_weekend",
    holiday: str | Column = "holiday_flag",
    rainy: str | Column = "is_rainy",
    friday: str | Column = "is_friday",
) -> dict[str, Column]:
    """P5: products of flags (friday_x_weekend is always 0, kept for the
    34-column contract)."""
    w, h, r, f = _c(is_weekend), _c(holiday), _c(rainy), _c(friday)
    return {
        "weekend_x_holiday": w * h,
        "rainy_x_weekend": r * w,
        "rainy_x_holiday": r * h,
        "friday_x_weekend": f * w,
    }
