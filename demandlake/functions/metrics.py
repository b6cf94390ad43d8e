"""Accuracy metrics as aggregate Column expressions (usable in any ``agg``,
grouped or global, so every series is scored in one pass). Every metric is
over the complete pairs: rows where actual and prediction are both present."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandlake.schema import SKLEARN_EPS


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _pair(y: str | Column, p: str | Column) -> tuple[Column, Column]:
    """Actual and prediction as doubles, both null unless both are present."""
    yy, pp = _c(y).cast("double"), _c(p).cast("double")
    return F.when(pp.isNotNull(), yy), F.when(yy.isNotNull(), pp)


def mape(y: str | Column, p: str | Column) -> Column:
    """M5: mean(|y - p| / max(|y|, eps)) x 100 (sklearn's epsilon)."""
    yy, pp = _pair(y, p)
    return F.avg(F.abs(yy - pp) / F.greatest(F.abs(yy), F.lit(SKLEARN_EPS))) * 100.0


def mae(y: str | Column, p: str | Column) -> Column:
    yy, pp = _pair(y, p)
    return F.avg(F.abs(yy - pp))


def rmse(y: str | Column, p: str | Column) -> Column:
    yy, pp = _pair(y, p)
    return F.sqrt(F.avg((yy - pp) * (yy - pp)))


def r2(y: str | Column, p: str | Column) -> Column:
    """M7: 1 - SSres/SStot; a constant target gives 1 when the fit is
    perfect, else 0. The division sits in the result projection, so the
    guard holds under ANSI mode. SStot is the population variance times n
    (no cancellation when the values are large and close together)."""
    yy, pp = _pair(y, p)
    ss_res = F.sum((yy - pp) * (yy - pp))
    ss_tot = F.var_pop(yy) * F.count(yy)
    return (
        F.when(ss_tot == 0, F.when(ss_res == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(F.lit(1.0) - F.try_divide(ss_res, ss_tot))
    )


def metric_columns(y: str | Column, p: str | Column) -> list[Column]:
    """mae, mape, rmse, r2, n of the complete pairs and the number of other
    rows, as aliased aggregate columns."""
    return [
        mae(y, p).alias("mae"),
        mape(y, p).alias("mape"),
        rmse(y, p).alias("rmse"),
        r2(y, p).alias("r2"),
        F.count(_pair(y, p)[0]).cast("bigint").alias("n_predictions"),
        (F.count(F.lit(1)) - F.count(_pair(y, p)[0])).cast("bigint").alias("n_excluded"),
    ]
