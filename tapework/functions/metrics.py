"""Forecast error and skill as aggregate expressions over ``pred`` and ``actual``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: smallest denominator of a percentage error (double precision epsilon).
EPSILON = 2.220446049250313e-16


def _error() -> Column:
    return F.col("actual") - F.col("pred")


def mae() -> Column:
    return F.avg(F.abs(_error()))


def rmse() -> Column:
    return F.sqrt(F.avg(_error() * _error()))


def mape() -> Column:
    return F.avg(F.abs(_error()) / F.greatest(F.abs("actual"), F.lit(EPSILON)))


def r2() -> Column:
    return F.lit(1.0) - F.sum(_error() * _error()) / F.nullif(F.regr_syy("actual", "actual"), F.lit(0.0))


def directional_accuracy() -> Column:
    return F.avg((F.signum("pred") == F.signum("actual")).cast("double"))


def ic_pearson(pred: str = "pred", actual: str = "actual") -> Column:
    """Correlation; NULL when either side is constant (the built-in raises there in ANSI mode)."""
    spread = F.stddev_pop(pred) * F.stddev_pop(actual)
    return F.covar_pop(pred, actual) / F.nullif(spread, F.lit(0.0))


def composite_loss(mape: Column, r2: Column, mae: Column, mean_abs: Column) -> Column:
    """Fixed weights 0.4, 0.4, 0.2."""
    return mape * 0.4 + (F.lit(1.0) - r2) * 0.4 + mae / F.nullif(mean_abs, F.lit(0.0)) * 0.2


def sharpe(value: str, zero_when_flat: bool, periods: int = 252) -> Column:
    ratio = F.avg(value) / F.nullif(F.stddev_pop(value), F.lit(0.0)) * F.sqrt(F.lit(float(periods)))
    return F.coalesce(ratio, F.lit(0.0)) if zero_when_flat else ratio
