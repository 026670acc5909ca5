"""Rollups of timing records: per-cell statistics, scaling exponents, ratios and matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rategrid.functions.naming import mean_pm_sem
from rategrid.functions.numeric import INFINITY, NAN, ceil_log2
from rategrid.operators.quantiles import exact_median
from rategrid.operators.ranks import thin

ABAR_FLOOR = 0.1
MIN_SIZES = 4


def timing_rollup(records: DataFrame, keys: Sequence[str] = ("model", "n", "p")) -> DataFrame:
    """Per cell: mean, population deviation and median time, k statistics, mean positive abar."""
    keys = list(keys)
    positive = F.when(F.col("abar") > 0, F.col("abar"))
    stats = records.groupBy(*keys).agg(
        F.avg("time").alias("t_mean"),
        F.stddev_pop("time").alias("t_std"),
        F.avg("k").alias("k_mean"),
        F.stddev_pop("k").alias("k_std"),
        F.avg(F.when(F.col("k") > 0, 1.0).otherwise(0.0)).alias("Pk"),
        F.coalesce(F.avg(positive), F.lit(0.0)).alias("abar_mean"),
        F.coalesce(F.stddev_pop(positive), F.lit(0.0)).alias("abar_std"),
        F.coalesce(F.avg(F.when(F.col("n") > 0, F.col("k") / F.col("n"))), F.lit(0.0)).alias("rate"),
        F.count(F.lit(1)).alias("count"),
    )
    return stats.join(exact_median(records, keys, "time", "t_median"), keys, "left").orderBy(*keys)


def scaling_exponents(cells: DataFrame, by: Sequence[str] = ("model", "p")) -> DataFrame:
    """Log-log slopes of time and abar against size, where at least four sizes have data."""
    usable = cells.where(F.col("t_mean") > 0)
    log_n = F.log(F.col("n").cast("double"))
    slopes = usable.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sizes"),
        F.regr_slope(F.log("t_mean"), log_n).alias("gamma_t"),
        F.regr_slope(F.log(F.greatest(F.col("abar_mean"), F.lit(ABAR_FLOOR))), log_n).alias("gamma_abar"),
    )
    return slopes.where(F.col("sizes") >= MIN_SIZES)


def layers(model: Column, n: Column, linear: str = "NN") -> Column:
    """Depth used for cost per layer: 8n for the linear model, else 8 ceil(log2 n)."""
    return F.when(model == linear, 8 * n).otherwise(8 * F.greatest(ceil_log2(n), F.lit(1)))


def normalised_costs(cells: DataFrame) -> DataFrame:
    """Cost per layer, per squared size, per gate, and abar per size."""
    n = F.col("n").cast("double")
    depth = layers(F.col("model"), F.col("n"))
    return cells.select(
        "*",
        (F.col("t_mean") / depth).alias("t_per_layer"),
        (F.col("t_mean") / (n * n)).alias("t_over_n2"),
        (F.col("t_mean") / F.floor(depth * F.col("n") / 2)).alias("t_per_gate"),
        (F.col("abar_mean") / n).alias("abar_over_n"),
    )


def paired_ratio(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("n", "p"), time: str = "t_mean") -> DataFrame:
    """Ratio of two timing tables on their common cells (b over a), infinite at zero time."""
    left = a.select(*keys, F.col(time).alias("t_a"))
    right = b.select(*keys, F.col(time).alias("t_b"))
    both = left.join(right, list(keys))
    return both.withColumn("ratio", F.when(F.col("t_a") > 0, F.col("t_b") / F.col("t_a")).otherwise(F.lit(INFINITY)))


def seed_rollup(
    runs: DataFrame, first: str, second: str, match: str, keys: Sequence[str] = ("n", "p")
) -> DataFrame:
    """Mean of two time columns over seeds, k of the first seed, speed-up and match counts."""
    means = runs.groupBy(*keys).agg(
        F.avg(first).alias("t_a"),
        F.avg(second).alias("t_b"),
        F.min_by("k", "seed").alias("k"),
        F.count(match).alias("verified"),
        F.count_if(match).alias("passed"),
        F.bool_and(match).alias("all_match"),
    )
    return means.withColumn("speedup", F.when(F.col("t_a") > 0, F.col("t_b") / F.col("t_a")).otherwise(F.lit(INFINITY)))


def side_by_side(cells: DataFrame, models: Sequence[str], value: str = "t_mean", keys: Sequence[str] = ("n", "p")) -> DataFrame:
    """One column per model, aligned on the cell."""
    return cells.groupBy(*keys).pivot("model", list(models)).agg(F.first(value))


def matrix(
    cells: DataFrame, value: str, columns: Sequence[float], row: str = "n", column: str = "p", by: Sequence[str] = ()
) -> DataFrame:
    """Dense size-by-rate matrix; NaN where a cell is absent.

    ``columns`` is the rate grid of the sweep, so no job is needed to discover it.
    """
    picked = [
        F.coalesce(F.max(F.when(F.abs(F.col(column) - F.lit(float(c))) < 1e-9, F.col(value))), F.lit(NAN)).alias(
            f"{column}={c:.4f}"
        )
        for c in columns
    ]
    return cells.groupBy(*by, row).agg(*picked)


def value_table(agg: DataFrame, sizes: Sequence[int], max_rows: int = 60) -> DataFrame:
    """Rate-by-size table of ``mean ± error`` text, thinned to ``max_rows`` rates."""
    grid = thin(agg.select("p").distinct(), "p", max_rows)
    text = mean_pm_sem(F.col("S_mean"), F.col("S_sem"))
    shown = agg.join(grid, "p").groupBy("p").agg(
        *[F.coalesce(F.max(F.when(F.col("n") == s, text)), F.lit("---")).alias(f"n={s}") for s in sizes]
    )
    return shown.select(F.format_string("%.4f", F.col("p")).alias("p"), *[f"`n={s}`" for s in sizes]).orderBy("p")
