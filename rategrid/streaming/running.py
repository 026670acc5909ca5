"""Running statistics per cell and windowed statistics of an event stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _moments(value: str) -> list[Column]:
    """Count, mean and sample deviation; Spark's own aggregates keep their precision far from zero."""
    v = F.col(value).cast("double")
    return [F.count(v).alias("count"), F.avg(v).alias("S_mean"), F.stddev_samp(v).alias("S_std")]


def running_cells(stream: DataFrame, value: str, keys: Sequence[str] = ("n", "p")) -> DataFrame:
    """Running statistics per cell; works on streams (update or complete mode) and batches."""
    return stream.groupBy(*keys).agg(*_moments(value))


def finish(cells: DataFrame) -> DataFrame:
    """Add the standard error of the mean."""
    return cells.withColumn("S_sem", F.col("S_std") / F.sqrt(F.col("count").cast("double")))


def windowed_cells(
    stream: DataFrame, time: str, value: str, keys: Sequence[str], length: str, late: str = "10 minutes"
) -> DataFrame:
    """The same statistics per event-time window, with a bound on late rows."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, length).alias("_w"), *keys)
    cells = grouped.agg(*_moments(value))
    return cells.select(F.col("_w.start").alias("window_start"), *keys, "count", "S_mean", "S_std")
