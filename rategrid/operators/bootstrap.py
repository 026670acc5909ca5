"""Percentile bootstrap of the mean, split over chunks of each group's distinct values.

Resampling ``m`` values with replacement is a multinomial draw over the distinct values.
A draw over chunks of values, followed by a draw inside each chunk, has the same
distribution, so one heavy group runs as many independent tasks.  Every task of a group
repeats the small draw over chunks from the same seed, which keeps the totals consistent.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rategrid.functions.columns import attach_summary, join_on
from rategrid.functions.numeric import finite
from rategrid.operators.quantiles import exact_quantiles

RESAMPLES = 1000
SEED = 42
CHUNK_VALUES = 50_000


def _resampled_sums(rows: pd.DataFrame, place: pd.Series, resamples: int, seed: int) -> np.ndarray:
    """Sum of the resampled values of one chunk, for every resample."""
    blocks, masses = (np.asarray(place[c], dtype=np.int64) for c in ("_blocks", "_masses"))
    block, slot, group_seed = int(place["_b"]), int(place["_slot"]), int(place["_group_hash"]) % (1 << 63)
    across = np.random.default_rng([seed, group_seed])
    drawn = across.multinomial(int(blocks.sum()), blocks / blocks.sum(), size=resamples)[:, block]
    within = np.random.default_rng([seed, group_seed, 1 + block])
    shares = within.multinomial(drawn, masses / masses.sum())[:, slot]
    ordered = rows.sort_values("_v")
    values = ordered["_v"].to_numpy(dtype=np.float64)
    weights = ordered["_copies"].to_numpy(dtype=np.float64)
    inside = np.random.default_rng([seed, group_seed, 1 + block, 1 + slot])
    sums = np.empty(resamples)
    step = max(1, 2_000_000 // len(values))
    for start in range(0, resamples, step):
        block = inside.multinomial(shares[start : start + step], weights / weights.sum())
        sums[start : start + step] = block @ values
    return sums


def bootstrap_interval(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    resamples: int = RESAMPLES,
    seed: int = SEED,
    level: float = 0.95,
    chunk_values: int = CHUNK_VALUES,
) -> DataFrame:
    """Half-widths ``err_low``/``err_high`` of the bootstrap interval, one row per group.

    Groups with one finite value or none get (0, 0).
    """
    keys = list(keys)
    rows = df.select(*keys, finite(F.col(value)).alias("_v"))
    counted = rows.where("_v is not null").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_copies"))
    sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_distinct"))
    # chunks lie in blocks of about as many chunks, so the layout a task sees grows with the root of the group only
    chunks = F.ceil(F.col("_distinct") / F.lit(chunk_values)).cast("bigint")
    placed = attach_summary(counted, sizes, keys).withColumn("_chunk", F.pmod(F.xxhash64("_v"), chunks))
    placed = placed.withColumn("_block", F.floor(F.col("_chunk") / F.ceil(F.sqrt(chunks.cast("double")))))
    # one small row per chunk tells its task how the group is divided
    masses = placed.groupBy(*keys, "_block", "_chunk").agg(F.sum("_copies").alias("_mass"))
    in_block = masses.groupBy(*keys, "_block").agg(
        F.array_sort(F.collect_list(F.struct("_chunk", "_mass"))).alias("_layout"), F.sum("_mass").alias("_held")
    )
    whole = in_block.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_block", "_held"))).alias("_all"), F.sum("_held").alias("_total")
    )
    listed = join_on(in_block, whole, keys)
    # own names for the keys: both sides of the cogroup stem from the same rows
    own = [f"_{k}" for k in keys]
    layout = listed.where("_total > 1").select(
        *[F.col(k).alias(name) for k, name in zip(keys, own)],
        F.posexplode("_layout._chunk").alias("_slot", "_place"),
        F.col("_layout._mass").alias("_masses"),
        (F.array_position("_all._block", F.col("_block")) - 1).alias("_b"),
        F.col("_all._held").alias("_blocks"),
        F.xxhash64(*keys).alias("_group_hash"),
    )
    out_schema = T.StructType(
        [rows.schema[k] for k in keys]
        + [T.StructField("resample", T.IntegerType()), T.StructField("_sum", T.DoubleType()), T.StructField("_n", T.LongType())]
    )

    def draw(values: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        if values.empty or places.empty:  # a group with a single value has no place
            return pd.DataFrame(columns=out_schema.names)
        place = places.iloc[0]
        out = pd.DataFrame({k: [place[name]] * resamples for k, name in zip(keys, own)})
        out["resample"] = np.arange(resamples, dtype=np.int32)
        out["_sum"] = _resampled_sums(values, place, resamples, seed)
        out["_n"] = int(np.sum(place["_blocks"]))
        return out

    sums = placed.groupBy(*keys, "_chunk").cogroup(layout.groupBy(*own, "_place")).applyInPandas(draw, out_schema)
    means = sums.groupBy(*keys, "resample").agg((F.sum("_sum") / F.first("_n")).alias("_mean"))
    tail = (1.0 - level) / 2.0
    bounds = means.groupBy(*keys).agg(
        # one value per resample: bounded by the number of resamples
        F.percentile("_mean", F.array(F.lit(tail), F.lit(1.0 - tail))).alias("_bounds")
    )
    centres = rows.groupBy(*keys).agg(F.avg("_v").alias("_centre"))
    joined = join_on(centres, bounds, keys, "left")
    return joined.select(
        *keys,
        F.coalesce(F.col("_centre") - F.col("_bounds")[0], F.lit(0.0)).alias("err_low"),
        F.coalesce(F.col("_bounds")[1] - F.col("_centre"), F.lit(0.0)).alias("err_high"),
    )
