"""Positions inside ordered groups without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rategrid.functions.columns import attach_summary


def ordered_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], coarse: Column, name: str = "t"
) -> DataFrame:
    """Zero-based position of each row in its group, ordered by ``order``.

    ``coarse`` must never decrease along that order (an hour for a timestamp, say).  Rows
    are numbered inside (group, coarse) slices; each slice starts after the counted sizes
    of the slices before it.
    """
    keys = list(keys)
    sliced = df.withColumn("_slice", coarse)
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_slice", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    placed = attach_summary(sliced, starts, [*keys, "_slice"])
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    position = F.col("_start") + F.row_number().over(inside) - 1
    return placed.withColumn(name, position.cast("bigint")).drop("_slice", "_start")


def thin(grid: DataFrame, order: str, limit: int, by: Sequence[str] = ()) -> DataFrame:
    """Keep at most ``limit`` evenly spaced rows of a grid, both ends included.

    For grids of cells or rates, which are bounded by the sweep's design: the positions
    are those of ``limit`` equal steps, rounded half to even, without repeats.
    """
    whole = Window.partitionBy(*by)
    indexed = grid.withColumn("_i", F.row_number().over(whole.orderBy(order)) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(whole)
    )
    step = (F.col("_n") - 1) / F.lit(float(max(limit - 1, 1)))
    marks = F.transform(
        F.sequence(F.lit(0), F.lit(max(limit - 1, 0))), lambda j: F.bround(j * step, 0).cast("int")
    )
    kept = indexed.where((F.col("_n") <= limit) | F.array_contains(marks, F.col("_i")))
    return kept.drop("_i", "_n")
