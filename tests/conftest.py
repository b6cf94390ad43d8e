import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from demandlake.session import ensure_checkpoint_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]")
        .appName("demandlake-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


def sales_rows(n, business="Restaurant", item="Jollof Rice", start=dt.date(2025, 6, 1), demand=None,
               price=50.0, shelf=4.0):
    """Hand-made daily sales rows (demand i+10 unless given)."""
    rows = []
    for i in range(n):
        d = demand[i] if demand is not None else 10 + i
        avail = d + 3
        sold = min(d, avail)
        rows.append((business, item, start + dt.timedelta(days=i), price, shelf, avail, sold, d,
                     max(avail - sold, 0), "Rainy" if i % 4 == 0 else "Clear", 1 if i % 9 == 0 else 0))
    return rows


SALES_DDL = ("business_type string, item_name string, date date, price double, shelf_life_hours double, "
             "quantity_available bigint, quantity_sold bigint, customer_demand bigint, waste_quantity bigint, "
             "weather_condition string, holiday_flag int")
