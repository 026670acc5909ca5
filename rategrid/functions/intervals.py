"""Interval estimates as aggregate columns, and the registry of error metrics.

An error metric is a function of one value column.  It returns two aggregate columns,
the half-widths below and above the mean, so any metric runs inside the same
partial/final aggregation as the mean itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rategrid.functions.numeric import finite

Z_DEFAULT = 1.96

ErrorMetric = Callable[[Column], tuple[Column, Column]]


def wilson_bounds(successes: Column, trials: Column, z: float = Z_DEFAULT) -> tuple[Column, Column]:
    """Wilson score interval for ``successes`` out of ``trials``; (0, 1) without trials."""
    size = F.when(trials > 0, trials.cast("double"))
    share = successes.cast("double") / size
    z2 = F.lit(float(z) * float(z))
    scale = F.lit(1.0) + z2 / size
    middle = (share + z2 / (F.lit(2.0) * size)) / scale
    spread = F.lit(float(z)) * F.sqrt(share * (F.lit(1.0) - share) / size + z2 / (F.lit(4.0) * size * size)) / scale
    return F.coalesce(middle - spread, F.lit(0.0)), F.coalesce(middle + spread, F.lit(1.0))


def sem(value: Column) -> tuple[Column, Column]:
    v = finite(value)
    half = F.when(F.count(v) > 1, F.stddev_samp(v) / F.sqrt(F.count(v).cast("double"))).otherwise(F.lit(0.0))
    return half, half


def std(value: Column) -> tuple[Column, Column]:
    v = finite(value)
    half = F.when(F.count(v) > 1, F.stddev_samp(v)).otherwise(F.lit(0.0))
    return half, half


def wilson(value: Column, z: float = Z_DEFAULT) -> tuple[Column, Column]:
    v = finite(value)
    total = F.count(v)
    # the number of successes is a whole count, as for 0/1 outcomes
    successes = F.floor(F.sum(v)).cast("double")
    low, high = wilson_bounds(successes, total, z)
    share = successes / F.when(total > 0, total)
    return F.coalesce(share - low, F.lit(0.0)), F.coalesce(high - share, F.lit(0.0))


def none(value: Column) -> tuple[Column, Column]:
    return F.lit(0.0), F.lit(0.0)


ERROR_METRICS: dict[str, ErrorMetric] = {"sem": sem, "std": std, "wilson": wilson, "none": none}

# Metrics that need their own distributed job instead of one aggregate expression.
JOB_METRICS = ("ci95",)


def register_error_metric(name: str, metric: ErrorMetric) -> None:
    ERROR_METRICS[name] = metric


def check_error_metric(name: str) -> str:
    known = sorted([*ERROR_METRICS, *JOB_METRICS])
    if name != "auto" and name not in known:
        raise ValueError(f"error_metric must be one of {known} or 'auto'; got {name!r}")
    return name


def group_is_binary(value: Column) -> tuple[Column, Column]:
    """(finite values seen, finite values other than 0 and 1) as aggregate columns."""
    v = finite(value)
    return F.count(v), F.count(F.when(~v.isin(0.0, 1.0), v))


def binary_integer(column: Column) -> Column:
    """Aggregate flag: an integer column with data whose values are all 0 or 1."""
    return (F.count(column) > 0) & (F.min(column) >= 0) & (F.max(column) <= 1)
