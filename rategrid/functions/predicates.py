"""Filters given as SQL text, size lists, rate lists and short conditions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rategrid.functions.columns import has_column

RATE_TOLERANCE = 1e-9


def where_text(df: DataFrame, text: str | None) -> DataFrame:
    """Apply SQL WHERE text; None or blank keeps every row."""
    return df if text is None or not text.strip() else df.where(text)


def size_in(sizes: Iterable[int] | None, column: str = "n") -> Column:
    return F.lit(True) if sizes is None else F.col(column).isin([int(s) for s in sizes])


def rate_in(rates: Sequence[float] | None, column: str = "p", tolerance: float = RATE_TOLERANCE) -> Column:
    """True where the rate lies within ``tolerance`` of a listed one (prunes partitions)."""
    if rates is None:
        return F.lit(True)
    hit = F.lit(False)
    for rate in rates:
        hit = hit | (F.abs(F.col(column) - F.lit(float(rate))) < F.lit(tolerance))
    return hit


_CONDITION = re.compile(r"\s*(>=|<=|==|!=|>|<)\s*(.*?)\s*$", re.S)


def condition(df: DataFrame, column: str, text: str) -> Column:
    """``column <op> number`` as a row predicate; unreadable text accepts every row."""
    match = _CONDITION.match(text)
    if match is None or not has_column(df, column):
        return F.lit(True)
    operator, number = match.groups()
    try:
        bound = F.lit(float(number))
    except ValueError:
        return F.lit(True)
    value = F.col(column).cast("double")
    tests = {
        ">=": value >= bound,
        "<=": value <= bound,
        "==": value == bound,
        "!=": value != bound,
        ">": value > bound,
        "<": value < bound,
    }
    return F.coalesce(tests[operator], F.lit(False))


def condition_or_nothing(df: DataFrame, column: str, text: str) -> Column:
    """As :func:`condition`, but a missing column selects no rows (the rollup's rule)."""
    return condition(df, column, text) if has_column(df, column) else F.lit(False)


def nearest(grid: DataFrame, targets: Sequence[float], column: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Per target, the grid value closest to it; ties go to the smaller value."""
    wanted = F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target")
    rows = grid.select(*by, column).distinct().select(*by, column, wanted)
    gap = F.abs(F.col(column) - F.col("target"))
    return rows.groupBy(*by, "target").agg(F.min_by(column, F.struct(gap, F.col(column))).alias(column))
