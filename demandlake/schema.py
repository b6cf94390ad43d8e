"""Schemas and fixed values.

Everything under "FIXED VALUES" must equal the behaviour being reproduced;
change them only together with the tests that pin them.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

SALES_SCHEMA = T.StructType(
    [
        T.StructField("business_type", T.StringType()),
        T.StructField("item_name", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("shelf_life_hours", T.DoubleType()),
        T.StructField("quantity_available", T.LongType()),
        T.StructField("quantity_sold", T.LongType()),
        T.StructField("customer_demand", T.LongType()),
        T.StructField("waste_quantity", T.LongType()),
        T.StructField("weather_condition", T.StringType()),
        T.StructField("holiday_flag", T.IntegerType()),
    ]
)

# CSV files are read as text first so that unparseable cells are counted by
# the quality rules instead of failing the read.
SALES_TEXT_SCHEMA = T.StructType(
    [T.StructField(f.name, T.StringType()) for f in SALES_SCHEMA.fields]
)

UPLOAD_SCHEMA = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("item_name", T.StringType()),
        T.StructField("quantity_sold", T.LongType()),
        T.StructField("quantity_available", T.LongType()),
    ]
)

WEEK_REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("item_name", T.StringType()),
        T.StructField("business_type", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("shelf_life_hours", T.DoubleType()),
        T.StructField("starting_date", T.StringType()),
        T.StructField("weather_forecast", T.ArrayType(T.StringType())),
        T.StructField("holiday_flags", T.ArrayType(T.IntegerType())),
    ]
)

DAY_REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("item_name", T.StringType()),
        T.StructField("business_type", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("shelf_life_hours", T.DoubleType()),
        T.StructField("weather", T.StringType()),
        T.StructField("is_holiday", T.IntegerType()),
    ]
)

ACCURACY_LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("mae", T.DoubleType()),
        T.StructField("mape", T.DoubleType()),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("r2", T.DoubleType()),
        T.StructField("n_predictions", T.LongType()),
        T.StructField("business_type", T.StringType()),
        T.StructField("item_name", T.StringType()),
    ]
)

REQUEST_LOG_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("latency_s", T.DoubleType()),
        T.StructField("fallback", T.BooleanType()),
    ]
)

SERIES_KEYS = ("business_type", "item_name")

# ---------------------------------------------------------------------------
# FIXED VALUES
# ---------------------------------------------------------------------------

# Required raw sales columns, in order.
REQUIRED_SALES_COLUMNS = [
    "business_type", "item_name", "date", "price", "shelf_life_hours",
    "quantity_available", "quantity_sold", "customer_demand",
    "waste_quantity", "weather_condition", "holiday_flag",
]

# Required columns of an uploaded sales file.
REQUIRED_UPLOAD_COLUMNS = ["date", "item_name", "quantity_sold"]

# Closed domains.
BUSINESS_TYPES = ["Restaurant", "Cafe", "Bakery"]
WEATHER_VALUES = ["Clear", "Rainy"]

# Category labels (encoded by alphabetical position).
CATEGORIES = [
    "main_meal", "side_dish", "beverage", "pastry", "dessert", "bakery",
    "light_meal",
]

# Known items: name -> (category, preparation_complexity).
KNOWN_ITEMS = {
    "Jollof Rice": ("main_meal", 3),
    "Fried Chicken": ("main_meal", 2),
    "Beef Stew": ("main_meal", 3),
    "Plantain": ("side_dish", 1),
    "Vegetable Soup": ("main_meal", 3),
    "Espresso": ("beverage", 1),
    "Cappuccino": ("beverage", 1),
    "Latte": ("beverage", 1),
    "Croissant": ("pastry", 2),
    "Sandwich": ("light_meal", 2),
    "White Bread": ("bakery", 4),
    "Croissants": ("pastry", 4),
    "Donuts": ("dessert", 3),
    "Cake Slice": ("dessert", 5),
    "Cookies": ("dessert", 2),
}

# Guess of an unknown item: default, then shelf-life / price stage
# (first match wins), then keyword stage (first matching group wins, and
# overrides the first stage). Keyword tests are lower-case substring tests.
GUESS_DEFAULT = ("main_meal", 2)
GUESS_SHELF_PRICE_RULES = [
    # (kind, threshold, category, complexity)
    ("shelf_lt", 2.0, "beverage", 1),
    ("shelf_gt", 24.0, "bakery", 3),
    ("shelf_gt", 12.0, "dessert", 3),
    ("price_lt", 25.0, "side_dish", 1),
]
GUESS_KEYWORD_GROUPS = [
    (["coffee", "tea", "juice", "smoothie", "latte", "espresso", "drink"], "beverage", 1),
    (["bread", "loaf"], "bakery", 4),
    (["cake", "donut", "cookie", "muffin", "pastry", "pie"], "dessert", 3),
    (["sandwich", "wrap", "roll"], "light_meal", 2),
]

# Model input: 34 feature columns, in order.
FEATURE_COLS = [
    "day_of_week", "month", "week_of_year", "day_of_month",
    "is_weekend", "is_monday", "is_friday", "is_saturday", "is_sunday",
    "day_sin", "day_cos", "month_sin", "month_cos",
    "holiday_flag", "is_rainy",
    "category_encoded", "preparation_complexity",
    "business_encoded", "price", "shelf_life_hours",
    "prev_day_demand", "prev_day_sold", "prev_day_waste", "prev_week_demand",
    "rolling_3day_demand", "rolling_7day_demand",
    "rolling_14day_demand", "rolling_30day_demand",
    "rolling_7day_std", "rolling_14day_std",
    "weekend_x_holiday", "rainy_x_weekend", "rainy_x_holiday", "friday_x_weekend",
]

LABEL_COL = "customer_demand"

# Rolling windows: mean lengths and std lengths, in rows.
ROLLING_MEANS = (3, 7, 14, 30)
ROLLING_STDS = (7, 14)

# History rows kept per series for forecasting, and horizon in days.
HISTORY_ROWS = 30
HORIZON_DAYS = 7
# Bands of days ahead by which forecasts are scored.
HORIZON_BANDS = {"1-2": (1, 2), "3-5": (3, 5), "6-7": (6, 7)}

# Forecast rules.
SAFETY_BUFFER = 1.05
CONFIDENCE_START = 0.85
CONFIDENCE_STEP = 0.05
CONFIDENCE_FLOOR = 0.55
CONFIDENCE_HIGH = 0.75
CONFIDENCE_MEDIUM = 0.60
SOLD_RATIO_AFTER_DAY1 = 0.95

# Waste risk: HIGH above 15 %, MEDIUM above 5 %, else LOW.
RISK_HIGH_PCT = 15.0
RISK_MEDIUM_PCT = 5.0
RISK_TEXT = {
    "HIGH": ("High waste risk - reduce quantity.", "red"),
    "MEDIUM": ("Moderate waste risk - consider reducing.", "yellow"),
    "LOW": ("Good planning - minimal waste expected.", "green"),
    "NONE": ("No production planned.", "green"),
}

# Recommendation: act when the difference exceeds 5 units either way.
RECOMMEND_BAND = 5
RECOMMEND_TEXT = {
    "REDUCE": "Current plan exceeds predicted demand - reducing avoids waste.",
    "INCREASE": "Current plan is below predicted demand - increasing avoids stockouts.",
    "MAINTAIN": "Current plan is within the optimal range.",
}

# Forecast explanation factors and fallback texts.
FACTOR_WEEKEND_UP = "weekend uplift"
FACTOR_WEEKEND_DOWN = "weekend drop"
FACTOR_HOLIDAY = "holiday effect"
FACTOR_RAIN = "rainy weather"
FALLBACK_CACHED_TEXT = "Model temporarily unavailable - showing last valid forecast"
FALLBACK_DEFAULT_TEXT = "Model unavailable. Please use recent sales history as a guide."

# Accuracy report texts.
DEGRADED_TEXT = "Model accuracy degraded - consider retraining."
NO_RECORDS_TEXT = "No matching records found."

# Monitoring thresholds.
DRIFT_MAPE = 25.0
TARGET_MAPE = 20.0
RETRAIN_MAPE = 12.0
RETRAIN_WINDOW = 7
RECENT_WINDOW = 7
SKLEARN_EPS = 2.220446049250313e-16

# Business-level default demand when nothing else is known (contract).
DEFAULT_DEMAND = {"Restaurant": 40, "Cafe": 50, "Bakery": 60}

# Request-log alerts (contract).
ALERT_FALLBACK_RATE = 0.10
ALERT_LATENCY_WARN_S = 3.0
ALERT_LATENCY_CRIT_S = 10.0
ALERT_ERROR_RUN = 10
ALERT_OUTAGE_MINUTES = 5
