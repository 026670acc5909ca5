"""Column helpers for null, NaN, infinity, rounding and guarded division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")
NAN = float("nan")


def finite(column: Column) -> Column:
    """The value as double, or null when it is null, NaN or infinite."""
    value = column.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(INFINITY)), value)


def skip_nan(column: Column) -> Column:
    """The value as double with NaN turned into null, so that aggregates ignore it."""
    value = column.cast("double")
    return F.when(~F.isnan(value), value)


def ratio(numerator: Column, denominator: Column, if_zero: float | None = None) -> Column:
    """Division that yields ``if_zero`` where the denominator is zero."""
    return F.when(denominator != 0, numerator.cast("double") / denominator).otherwise(F.lit(if_zero).cast("double"))


def clip(column: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(column, F.lit(low)), F.lit(high))


def half_even(column: Column) -> Column:
    """Round to the nearest integer, ties to even."""
    return F.bround(column, 0).cast("bigint")


def ceil_log2(column: Column) -> Column:
    """Smallest integer ``m`` with ``2**m >= column`` (0 for 1), exact at powers of two."""
    whole = (column - 1).cast("bigint")
    return F.when(column <= 1, F.lit(0)).otherwise(F.length(F.bin(whole))).cast("int")
