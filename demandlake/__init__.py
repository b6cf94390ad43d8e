"""demandlake: daily demand analytics as Spark DataFrame operators.

Layout
------
- ``schema``      fixed schemas and the fixed values the results depend on
- ``session``     session helpers (checkpoint folder, size-checked broadcast)
- ``sources``     readers/writers: sales CSV/Parquet, history, metrics log, models,
                  and the ``sales`` view derived from the driver's test tables
- ``functions``   Column-level building blocks (calendar, items, rules, metrics)
- ``operators``   DataFrame -> DataFrame operators (features, windows, EDA,
                  quality, decisions, monitoring, contract jobs)
- ``plans``       multi-step jobs: model training, recursive forecasting,
                  retraining, and the registered query catalog
- ``streaming``   Structured Streaming jobs (validated ingest, accuracy, risk)
"""

__version__ = "0.1.0"
