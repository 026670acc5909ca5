"""Time series per sample: survival curves, first-zero times and their summary per cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rategrid.functions.columns import join_on
from rategrid.functions.numeric import clip

CELL = ("n", "p")
SAMPLE_ID = ("run_id", "sample_seed")  # seeds repeat across runs


def sample_id(df: DataFrame) -> list[str]:
    """The columns that name a sample inside a cell; a table of one run may lack ``run_id``."""
    return [c for c in SAMPLE_ID if c in df.columns]


def pad_trace(trace: Column, cap: Column) -> Column:
    """Extend an early-stopped trace with zeros to ``cap + 1`` entries."""
    return F.concat(trace, F.array_repeat(F.lit(0), F.greatest(cap + 1 - F.size(trace), F.lit(0)).cast("int")))


def first_zero(trace: Column) -> Column:
    """Index of the first zero in a trace, or null if it never reaches zero."""
    position = F.array_position(trace, F.lit(0).cast("int"))
    return F.when(position > 0, position - 1)


def explode_traces(df: DataFrame, trace: str = "s", keys: Sequence[str] | None = None) -> DataFrame:
    """One row per sample and time step from one array per sample."""
    keys = [*CELL, *sample_id(df)] if keys is None else keys
    return df.select(*keys, F.posexplode(trace).alias("t", "s"))


def survival_band(trace: DataFrame, keys: Sequence[str] = CELL, padded: bool = True) -> DataFrame:
    """Mean of ``s`` per (cell, t) with its standard error and the band clipped to [0, 1].

    With ``padded`` every sample of the cell counts at every t, as zero after its own end;
    the missing zeros enter only through the sample count, no rows are made up for them.
    """
    keys = list(keys)
    sums = trace.groupBy(*keys, "t").agg(
        F.sum("s").cast("double").alias("_s1"),
        F.sum(F.col("s") * F.col("s")).cast("double").alias("_s2"),
        F.count("s").alias("_m"),
    )
    if padded:
        totals = trace.groupBy(*keys).agg(F.countDistinct(F.struct(*sample_id(trace))).alias("_total"))
        sums = join_on(sums, totals, keys).withColumn("_m", F.col("_total"))
    m = F.col("_m").cast("double")
    mean = F.col("_s1") / m
    variance = F.greatest(F.col("_s2") - F.col("_s1") * F.col("_s1") / m, F.lit(0.0)) / (m - 1)
    sem = F.when(F.col("_m") > 1, F.sqrt(variance) / F.sqrt(m)).otherwise(F.lit(0.0))
    return sums.select(*keys, "t", mean.alias("mean_s"), sem.alias("sem"), F.col("_m").alias("n_samples")).select(
        "*", clip(F.col("mean_s") - F.col("sem"), 0.0, 1.0).alias("low"), clip(F.col("mean_s") + F.col("sem"), 0.0, 1.0).alias("high")
    )


def rescaled(curve: DataFrame, size: str = "n") -> DataFrame:
    """Add the time axis in units of the system size."""
    return curve.withColumn("t_over_n", F.col("t") / F.col(size))


def crossing_time(curve: DataFrame, threshold: float = 0.5, keys: Sequence[str] = CELL, value: str = "mean_s") -> DataFrame:
    """First time each cell's curve is at or below ``threshold``, interpolated; null if never.

    The point before is the latest earlier time that has a row, however far back; no cell is sorted.
    0 where the first row is a hit.
    """
    keys = list(keys)
    hits = (
        curve.where(F.col(value) <= threshold)
        .groupBy(*keys)
        .agg(F.min("t").alias("t"), F.min_by(value, "t").alias("_now"))
    )
    hit_times = hits.select(*keys, F.col("t").alias("_hit"))
    earlier = join_on(curve.select(*keys, "t", F.col(value).alias("_v")), hit_times, keys).where(F.col("t") < F.col("_hit"))
    previous = earlier.groupBy(*keys).agg(F.max("t").alias("_before"), F.max_by("_v", "t").alias("_prev"))
    located = join_on(hits, previous, keys, "left")
    fraction = (F.col("_prev") - F.lit(threshold)) / (F.col("_prev") - F.col("_now"))
    time = (
        F.when(F.col("_prev").isNull(), F.lit(0.0))
        .when(F.col("_prev") == F.col("_now"), F.col("t").cast("double"))
        .otherwise(F.col("_before") + fraction * (F.col("t") - F.col("_before")))
    )
    cells = curve.select(*keys).distinct()
    return join_on(cells, located.select(*keys, time.alias("tau_interp")), keys, "left")


def sample_times(trace: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """First time with s = 0 per sample (null if censored) and the last recorded time."""
    keys = [*CELL, *sample_id(trace)] if keys is None else keys
    return trace.groupBy(*keys).agg(
        F.min(F.when(F.col("s") == 0, F.col("t"))).alias("tau"), F.max("t").alias("last_t")
    )


def tau_table(trace: DataFrame, threshold: float = 0.5, keys: Sequence[str] = CELL, size: str = "n") -> DataFrame:
    """One row per cell: threshold time, mean first-zero time with its error, censoring."""
    keys = list(keys)
    interpolated = crossing_time(survival_band(trace, keys), threshold, keys)
    per_sample = sample_times(trace, [*keys, *sample_id(trace)])
    n = F.col(size).cast("double")
    stats = per_sample.groupBy(*keys).agg(
        F.avg("tau").alias("tau_mean"),
        F.stddev_samp("tau").alias("_sd"),
        F.count("tau").alias("n_purified"),
        F.count(F.lit(1)).alias("n_total"),
        F.max("last_t").alias("cap"),
    )
    done = F.col("n_purified")
    deviation = F.when(done > 1, F.col("_sd")).when(done == 1, F.lit(0.0))
    error = F.when(done > 1, F.col("_sd") / F.sqrt(done.cast("double"))).when(done == 1, F.lit(0.0))
    return (
        join_on(stats, interpolated, keys)
        .select(
            *keys,
            "tau_interp",
            (F.col("tau_interp") / n).alias("tau_interp_over_n"),
            "tau_mean",
            deviation.alias("tau_std"),
            error.alias("tau_sem"),
            (F.col("tau_mean") / n).alias("tau_mean_over_n"),
            (error / n).alias("tau_sem_over_n"),
            F.col("tau_mean").alias("tau"),
            (F.col("tau_mean") / n).alias("tau_over_n"),
            "n_purified",
            "n_total",
            (F.lit(1.0) - done / F.greatest(F.col("n_total"), F.lit(1))).alias("censor_frac"),
            F.col("cap").cast("bigint").alias("cap"),
            (done == 0).alias("capped"),
        )
        .orderBy(*sorted(keys, reverse=True))
    )
