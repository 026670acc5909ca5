"""Critical-rate estimates from mean curves: crossings of two sizes and half-value points.

The input is an aggregated curve, one row per (group, n, p).  Windows here run over the
rate grid of one group; its length is set by the sweep's design, not by the sample count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLATEAU = 1e-12
METHODS = ("crossing", "half")


def _grouped(agg: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (agg, list(by)) if by else (agg.withColumn("_all", F.lit(0)), ["_all"])


def largest_sizes(agg: DataFrame, by: Sequence[str]) -> DataFrame:
    """Largest and second largest size of each group."""
    sizes = F.sort_array(F.collect_set("n"), asc=False)
    return agg.groupBy(*by).agg(sizes.alias("_sizes")).select(
        *by, F.get("_sizes", F.lit(0)).alias("n_big"), F.get("_sizes", F.lit(1)).alias("n_small")
    )


def interpolate(df: DataFrame, by: Sequence[str], x: str, y: str, name: str) -> DataFrame:
    """Fill nulls of ``y`` linearly between neighbours in ``x``, clamped at both ends."""
    point = F.when(F.col(y).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    order = Window.partitionBy(*by).orderBy(x)
    left = F.last(point, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(point, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    marked = df.withColumn("_l", left).withColumn("_r", right)
    slope = (F.col("_r.y") - F.col("_l.y")) / F.nullif(F.col("_r.x") - F.col("_l.x"), F.lit(0.0))
    between = F.col("_l.y") + slope * (F.col(x) - F.col("_l.x"))
    filled = F.coalesce(F.col(y), between, F.col("_l.y"), F.col("_r.y"))
    return marked.withColumn(name, filled).drop("_l", "_r")


def aligned_curves(agg: DataFrame, by: Sequence[str], value: str = "S_mean") -> DataFrame:
    """The two largest sizes on the union of their rate grids, both interpolated."""
    marked = agg.join(largest_sizes(agg, by), list(by))
    pair = (
        marked.where((F.col("n") == F.col("n_big")) | (F.col("n") == F.col("n_small")))
        .groupBy(*by, "p")
        .agg(
            F.max(F.when(F.col("n") == F.col("n_big"), F.col(value))).alias("_big"),
            F.max(F.when(F.col("n") == F.col("n_small"), F.col(value))).alias("_small"),
        )
    )
    filled = interpolate(interpolate(pair, by, "p", "_big", "s_big"), by, "p", "_small", "s_small")
    return filled.select(*by, "p", "s_big", "s_small", (F.col("s_big") - F.col("s_small")).alias("diff"))


def crossing_rate(agg: DataFrame, by: Sequence[str] = (), value: str = "S_mean") -> DataFrame:
    """Rate of the first true sign change between the two largest sizes, null without one.

    Points where the curves coincide are skipped; the sign before such a plateau is the
    one compared against, and the root is taken on the line through the two points after it.
    """
    rows, keys = _grouped(agg, by)
    curves = aligned_curves(rows, keys, value)
    order = Window.partitionBy(*keys).orderBy("p")
    flat = F.abs(F.col("diff")) < PLATEAU
    sign = F.when(~flat, F.signum("diff"))
    walked = curves.select(
        *keys,
        "p",
        "diff",
        sign.alias("_sign"),
        F.coalesce(F.lag(flat).over(order), F.lit(False)).alias("_after_flat"),
        F.last(sign, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.lead("p").over(order).alias("_p1"),
        F.lead("diff").over(order).alias("_d1"),
        F.lead(sign).over(order).alias("_sign1"),
    )
    reference = F.when(F.col("_after_flat"), F.coalesce("_earlier", "_sign")).otherwise(F.col("_sign"))
    changed = F.col("_sign").isNotNull() & (reference * F.col("_sign1") < 0)
    step = F.nullif(F.col("_d1") - F.col("diff"), F.lit(0.0))
    root = F.coalesce(F.col("p") - F.col("diff") * (F.col("_p1") - F.col("p")) / step, F.col("p"))
    first = walked.where(changed).groupBy(*keys).agg(F.min_by(root, "p").alias("p_crossing"))
    out = rows.select(*keys).distinct().join(first, keys, "left")
    return out.select(*by, "p_crossing")


def halving_rate(agg: DataFrame, by: Sequence[str] = (), value: str = "S_mean", level: float = 0.5) -> DataFrame:
    """Rate at which the largest size's curve first reaches ``level``, interpolated."""
    rows, keys = _grouped(agg, by)
    big = rows.join(largest_sizes(rows, keys), keys).where(F.col("n") == F.col("n_big"))
    order = Window.partitionBy(*keys).orderBy("p")
    walked = big.select(
        *keys, "p", F.col(value).alias("_s"), F.lag("p").over(order).alias("_p0"), F.lag(value).over(order).alias("_s0")
    )
    drop = F.nullif(F.col("_s0") - F.col("_s"), F.lit(0.0))
    point: Column = F.coalesce(F.col("_p0") + (F.col("_s0") - level) / drop * (F.col("p") - F.col("_p0")), F.col("p"))
    first = walked.where(F.col("_s") <= level).groupBy(*keys).agg(F.min_by(point, "p").alias("p_half"))
    out = rows.select(*keys).distinct().join(first, keys, "left")
    return out.select(*by, "p_half")


def critical_rate(agg: DataFrame, method: str = "crossing", by: Sequence[str] = (), value: str = "S_mean") -> DataFrame:
    """Crossing estimate with the half-value point as fallback, or only the latter."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {METHODS}")
    half = halving_rate(agg, by, value)
    if method == "half":
        return half.withColumnRenamed("p_half", "p_c")
    cross = crossing_rate(agg, by, value)
    if by:
        both = cross.join(half, list(by))
    else:  # one row each
        both = cross.withColumn("_k", F.lit(0)).join(half.withColumn("_k", F.lit(0)), "_k").drop("_k")
    return both.select(*by, F.coalesce("p_crossing", "p_half").alias("p_c"))


def peak_rate(agg: DataFrame, value: str, by: Sequence[str] = ("n",)) -> DataFrame:
    """Rate at which a curve is largest; ties go to the smaller rate."""
    return agg.groupBy(*by).agg(F.max_by("p", F.struct(F.col(value), -F.col("p"))).alias("p_peak"))


def curve_summary(agg: DataFrame, count: str = "count") -> DataFrame:
    """Sizes, rate range, number of rates and cells, and total samples of a curve table."""
    totals = agg.agg(
        F.sort_array(F.collect_set(F.col("n").cast("bigint"))).alias("sizes"),
        F.min("p").alias("p_min"),
        F.max("p").alias("p_max"),
        F.countDistinct("p").alias("n_p"),
        F.sum(count).cast("bigint").alias("total_samples"),
    )
    return totals.withColumn("total_cells", (F.size("sizes") * F.col("n_p")).cast("bigint"))
