"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def rounded(value, digits: int = 6) -> Column:
    """Round for output only; adding 0.0 folds -0.0 into 0.0."""
    return F.round(as_col(value).cast("double"), digits) + F.lit(0.0)


def ratio(num, den) -> Column:
    """num / den, NULL when the denominator is 0."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def ratio0(num, den) -> Column:
    """num / den, 0 when the denominator is 0."""
    return F.coalesce(ratio(num, den), F.lit(0.0))


def is_finite(value) -> Column:
    v = as_col(value)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def finite_or_zero(value) -> Column:
    v = as_col(value)
    return F.when(is_finite(v), v).otherwise(F.lit(0.0))


def lerp(t, t0, v0, t1, v1) -> Column:
    """Linear interpolation; returns v0 when both support points coincide."""
    t, t0, v0, t1, v1 = map(as_col, (t, t0, v0, t1, v1))
    span = (t1 - t0).cast("double")
    return F.when(t1 == t0, v0).otherwise(v0 + (v1 - v0) * F.try_divide((t - t0).cast("double"), span))


def require(condition: Column, value, message: str) -> Column:
    """`value` where the condition holds, otherwise the task fails."""
    return F.when(condition, as_col(value)).otherwise(F.raise_error(F.lit(message)))


def floor_div(value, width: int) -> Column:
    """Integer bucket that is also right for negative values."""
    return F.floor(as_col(value) / F.lit(width)).cast("long")


def ceil_rank(q, n) -> Column:
    """0-based position ceil(q * (n - 1)) of the upper ("higher") quantile."""
    return F.ceil(as_col(q).cast("double") * (as_col(n) - 1)).cast("long")
