"""Mean curves with error bars: one row per (size, x)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rategrid.functions.aliases import ensure_column
from rategrid.functions.columns import join_on, require_column
from rategrid.functions.intervals import ERROR_METRICS, check_error_metric, group_is_binary
from rategrid.functions.numeric import NAN, skip_nan
from rategrid.functions.predicates import rate_in, size_in, where_text
from rategrid.operators.bootstrap import bootstrap_interval
from rategrid.session import cut_lineage


def pick_metric_flag(cells: DataFrame) -> Column:
    """Scalar subquery over the aggregated cells: are all finite values 0 or 1?"""
    verdict = cells.agg(((F.sum("_seen") > 0) & (F.sum("_other") == 0)).alias("binary"))
    return F.coalesce(verdict.scalar(), F.lit(False))


def aggregate_curve(
    df: DataFrame, y: str, x: str = "p", error_metric: str = "auto", by: Sequence[str] = ()
) -> DataFrame:
    """Per (n, x): mean without NaN, error half-widths, number of rows.

    ``auto`` uses Wilson intervals if every finite value of the whole input is 0 or 1,
    else the standard error.  The decision is read from the aggregated cells, which are
    materialised for it, so the input is scanned once.
    """
    check_error_metric(error_metric)
    df = ensure_column(df, y)
    require_column(df, y)
    require_column(df, x)
    rows = df.select(
        *by,
        F.col("n").cast("bigint").alias("n"),
        F.col(x).cast("double").alias(x),
        F.col(y).cast("double").alias("_y"),
    )
    keys = [*by, "n", x]
    value = F.col("_y")
    base = [F.coalesce(F.avg(skip_nan(value)), F.lit(NAN)).alias("mean")]
    if error_metric == "auto":
        seen, other = group_is_binary(value)
        options = {name: ERROR_METRICS[name](value) for name in ("wilson", "sem")}
        aggregated = rows.groupBy(*keys).agg(
            *base,
            *[side.alias(f"_{name}_{i}") for name, sides in options.items() for i, side in enumerate(sides)],
            F.count(F.lit(1)).alias("n_samples"),
            seen.alias("_seen"),
            other.alias("_other"),
        )
        cells = cut_lineage(aggregated)
        binary = pick_metric_flag(cells)
        low, high = (F.when(binary, F.col(f"_wilson_{i}")).otherwise(F.col(f"_sem_{i}")) for i in (0, 1))
        cells = cells.select(*keys, "mean", low.alias("err_low"), high.alias("err_high"), "n_samples")
    elif error_metric == "ci95":
        means = rows.groupBy(*keys).agg(*base, F.count(F.lit(1)).alias("n_samples"))
        bars = bootstrap_interval(rows, keys, "_y")
        cells = join_on(means, bars, keys, "left").select(*keys, "mean", "err_low", "err_high", "n_samples")
    else:
        low, high = ERROR_METRICS[error_metric](value)
        cells = rows.groupBy(*keys).agg(
            *base, low.alias("err_low"), high.alias("err_high"), F.count(F.lit(1)).alias("n_samples")
        )
    return cells.orderBy(*keys)


def curve(
    df: DataFrame,
    y: str,
    x: str = "p",
    sizes: Iterable[int] | None = None,
    rates: Sequence[float] | None = None,
    where: str | None = None,
    error_metric: str = "auto",
    by: Sequence[str] = (),
) -> DataFrame:
    """The data of a "y versus x" figure: alias, filter, then aggregate."""
    df = where_text(ensure_column(df, y), where)
    df = df.where(size_in(sizes)).where(rate_in(rates))
    return aggregate_curve(df, y, x, error_metric, by)


def require_rows(df: DataFrame, what: str = "no data after filtering") -> DataFrame:
    """Raise if ``df`` is empty; for callers that run an action anyway."""
    if df.isEmpty():
        raise ValueError(what)
    return df
