"""Expressions shared by the operators. Null means "unknown" throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(num: Column, den: Column) -> Column:
    """Ratio that is null, not an error, on a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def share(pred: Column) -> Column:
    """Mean of a predicate; rows where it is unknown are left out of the denominator."""
    return F.avg(pred.cast("double"))


def sum0(value: Column) -> Column:
    """Sum that is 0 when there is nothing to add."""
    return F.coalesce(F.sum(value), F.lit(0.0))


def count0(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("long")


def sum_where(pred: Column, value: Column) -> Column:
    return sum0(F.when(pred, value))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds, truncated."""
    return F.timestamp_diff("SECOND", start, end)


def iso_weekday(ts: Column) -> Column:
    """Monday = 1 .. Sunday = 7."""
    return F.weekday(ts) + 1


def at_least_zero(value: Column) -> Column:
    """Clip below at zero and keep null as null."""
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def finite_or_null(value: Column) -> Column:
    """NaN and infinities become null."""
    inf = F.lit(float("inf"))
    return F.when(F.isnan(value) | (F.abs(value) == inf), None).otherwise(value)
