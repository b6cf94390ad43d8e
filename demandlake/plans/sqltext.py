"""DuckDB SQL fragments for the oracle side of registered queries.

These restate the column rules in SQL; the fixed values come from
``demandlake.schema`` so both sides use the same constants.
"""

from __future__ import annotations

import math

from demandlake.schema import (
    BUSINESS_TYPES,
    CATEGORIES,
    GUESS_DEFAULT,
    GUESS_KEYWORD_GROUPS,
    GUESS_SHELF_PRICE_RULES,
    KNOWN_ITEMS,
)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def calendar_sql(d: str = "date") -> str:
    dow = f"(isodow({d}) - 1)"
    return f"""
      {dow} AS day_of_week, dayname({d}) AS day_name, month({d}) AS month,
      weekofyear({d}) AS week_of_year, dayofmonth({d}) AS day_of_month,
      CAST({dow} >= 5 AS INTEGER) AS is_weekend, CAST({dow} = 0 AS INTEGER) AS is_monday,
      CAST({dow} = 4 AS INTEGER) AS is_friday, CAST({dow} = 5 AS INTEGER) AS is_saturday,
      CAST({dow} = 6 AS INTEGER) AS is_sunday"""


def cyclical_sql(dow: str = "day_of_week", month: str = "month") -> str:
    tp = repr(2 * math.pi)
    return f"""
      sin({tp} * {dow} / 7) AS day_sin, cos({tp} * {dow} / 7) AS day_cos,
      sin({tp} * {month} / 12) AS month_sin, cos({tp} * {month} / 12) AS month_cos"""


def interactions_sql() -> str:
    return """
      is_weekend * holiday_flag AS weekend_x_holiday, is_rainy * is_weekend AS rainy_x_weekend,
      is_rainy * holiday_flag AS rainy_x_holiday, is_friday * is_weekend AS friday_x_weekend"""


def rainy_sql(w: str = "weather_condition") -> str:
    return f"CAST(coalesce({w} = 'Rainy', false) AS INTEGER)"


def _guess_case(name: str, price: str, shelf: str, keywords: bool, pos: int) -> str:
    first = "CASE"
    for kind, thr, cat, cx in GUESS_SHELF_PRICE_RULES:
        cond = {"shelf_lt": f"{shelf} < {thr}", "shelf_gt": f"{shelf} > {thr}", "price_lt": f"{price} < {thr}"}[kind]
        val = lit(cat) if pos == 0 else str(cx)
        first += f" WHEN coalesce({cond}, false) THEN {val}"
    first += f" ELSE {lit(GUESS_DEFAULT[0]) if pos == 0 else GUESS_DEFAULT[1]} END"
    if not keywords:
        return first
    out = "CASE"
    for words, cat, cx in GUESS_KEYWORD_GROUPS:
        cond = " OR ".join(f"coalesce(contains(lower({name}), {lit(w)}), false)" for w in words)
        out += f" WHEN {cond} THEN {lit(cat) if pos == 0 else cx}"
    return out + f" ELSE {first} END"


def item_sql(name: str = "item_name", price: str = "price", shelf: str = "shelf_life_hours",
             keywords: bool = True) -> tuple[str, str]:
    """(category expr, complexity expr): known lookup, then guess."""
    kc = "CASE " + " ".join(f"WHEN {name} = {lit(k)} THEN {lit(v[0])}" for k, v in KNOWN_ITEMS.items()) + " END"
    kx = "CASE " + " ".join(f"WHEN {name} = {lit(k)} THEN {v[1]}" for k, v in KNOWN_ITEMS.items()) + " END"
    cat = f"coalesce({kc}, {_guess_case(name, price, shelf, keywords, 0)})"
    cx = f"CAST(coalesce({kx}, {_guess_case(name, price, shelf, keywords, 1)}) AS INTEGER)"
    return cat, cx


def encode_sql(col: str, labels: list[str]) -> str:
    arr = "[" + ", ".join(lit(x) for x in sorted(labels)) + "]"
    return f"CAST(list_position({arr}, {col}) - 1 AS INTEGER)"


def category_code_sql(col: str = "category") -> str:
    return encode_sql(col, CATEGORIES)


def business_code_sql(col: str = "business_type") -> str:
    return encode_sql(col, BUSINESS_TYPES)


def windows_sql(include_current: bool = True, part: str = "business_type, item_name",
                order: str = "date") -> str:
    w = f"PARTITION BY {part} ORDER BY {order}"

    def fr(n: int) -> str:
        return (f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW" if include_current
                else f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING")

    return f"""
      lag(customer_demand, 1) OVER ({w}) AS prev_day_demand,
      lag(quantity_sold, 1) OVER ({w}) AS prev_day_sold,
      lag(waste_quantity, 1) OVER ({w}) AS prev_day_waste,
      lag(customer_demand, 7) OVER ({w}) AS prev_week_demand,
      avg(customer_demand) OVER ({w} {fr(3)}) AS rolling_3day_demand,
      avg(customer_demand) OVER ({w} {fr(7)}) AS rolling_7day_demand,
      avg(customer_demand) OVER ({w} {fr(14)}) AS rolling_14day_demand,
      avg(customer_demand) OVER ({w} {fr(30)}) AS rolling_30day_demand,
      stddev_samp(customer_demand) OVER ({w} {fr(7)}) AS rolling_7day_std,
      stddev_samp(customer_demand) OVER ({w} {fr(14)}) AS rolling_14day_std"""


def features_sql(src: str = "sales", include_current: bool = True) -> str:
    """Full 34-feature table over ``src`` as a CTE body (numeric nulls -> 0)."""
    cat, cx = item_sql()
    return f"""
    f1 AS (
      SELECT s.*, {calendar_sql()}, {rainy_sql()} AS is_rainy,
             {cat} AS category, {cx} AS preparation_complexity
      FROM {src} s
    ),
    f2 AS (
      SELECT f1.*, {category_code_sql()} AS category_encoded, {business_code_sql()} AS business_encoded,
             {windows_sql(include_current)}
      FROM f1
    ),
    feats AS (
      SELECT * REPLACE (
               coalesce(prev_day_demand, 0) AS prev_day_demand, coalesce(prev_day_sold, 0) AS prev_day_sold,
               coalesce(prev_day_waste, 0) AS prev_day_waste, coalesce(prev_week_demand, 0) AS prev_week_demand,
               coalesce(rolling_3day_demand, 0) AS rolling_3day_demand,
               coalesce(rolling_7day_demand, 0) AS rolling_7day_demand,
               coalesce(rolling_14day_demand, 0) AS rolling_14day_demand,
               coalesce(rolling_30day_demand, 0) AS rolling_30day_demand,
               coalesce(rolling_7day_std, 0) AS rolling_7day_std,
               coalesce(rolling_14day_std, 0) AS rolling_14day_std),
             {interactions_sql()}, {cyclical_sql()}
      FROM f2
    )"""
