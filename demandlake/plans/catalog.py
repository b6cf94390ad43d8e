"""Imports every query module so the registry is complete."""

from __future__ import annotations

from demandlake.plans import (  # noqa: F401
    q_backtest,
    q_decide,
    q_eda,
    q_features,
    q_forecast_fixed,
    q_io,
    q_models,
    q_monitor,
    q_quality,
    q_stream,
)
from demandlake.plans.registry import REGISTRY

FLAGSHIP = "features_full"


def queries():
    return {name: q.fn for name, q in REGISTRY.items()}


def oracle_sql():
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}
