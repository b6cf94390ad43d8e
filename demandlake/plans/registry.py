"""Query registry shared by the driver entry point, tests and bench.

Each registered query is ``fn(spark, sf_dir) -> DataFrame``; most also
carry DuckDB SQL over the same Parquet tables. Output columns are declared
once with a type code so both engines emit the same schema:

    s string | i bigint | d double rounded to 6 places | b boolean | t date/timestamp as ISO text
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    fn: QueryFn
    cols: list[tuple[str, str]]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def parse_cols(spec: str) -> list[tuple[str, str]]:
    out = []
    for part in spec.split(","):
        name, code = part.strip().split(":")
        out.append((name.strip(), code.strip()))
    return out


def normalize(df: DataFrame, cols: list[tuple[str, str]]) -> DataFrame:
    """Project ``df`` to the declared columns and types."""
    exprs = []
    for name, code in cols:
        c = F.col(name)
        if code == "s":
            e = c.cast("string")
        elif code == "i":
            e = c.cast("bigint")
        elif code == "d":
            e = F.round(c.cast("double"), 6)
        elif code == "b":
            e = c.cast("boolean")
        elif code == "t":
            e = c.cast("string")
        else:
            raise ValueError(code)
        exprs.append(e.alias(name))
    return df.select(*exprs)


def wrap_sql(sql: str, cols: list[tuple[str, str]]) -> str:
    """Wrap oracle SQL so its output matches ``normalize``."""
    exprs = []
    for name, code in cols:
        q = f'q."{name}"'
        e = {
            "s": f"CAST({q} AS VARCHAR)",
            "i": f"CAST({q} AS BIGINT)",
            "d": f"round(CAST({q} AS DOUBLE), 6)",
            "b": f"CAST({q} AS BOOLEAN)",
            "t": f"CAST({q} AS VARCHAR)",
        }[code]
        exprs.append(f'{e} AS "{name}"')
    return f"SELECT {', '.join(exprs)} FROM (\n{sql.strip()}\n) q"


def register(name: str, cols: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir)`` under ``name``."""
    spec = parse_cols(cols)

    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return normalize(fn(spark, sf_dir), spec)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, run, spec, wrap_sql(sql, spec) if sql else None)
        return fn

    return deco
