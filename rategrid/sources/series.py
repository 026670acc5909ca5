"""Time series and schedules stored as nested arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rategrid.sources.runs import read_glob, with_run_id


def load_traces(spark: SparkSession, run: str) -> DataFrame | None:
    """One row per sample with its array ``s``; None if the run has no time series."""
    df = read_glob(spark, run, "n=*/p=*/timeseries.parquet")
    return None if df is None else with_run_id(df, run)


def load_realizations(spark: SparkSession, run: str) -> DataFrame | None:
    """One row per sample and layer: ``gates array<struct<u,v,c>>`` and ``meas array<int>``."""
    df = read_glob(spark, run, "n=*/p=*/realizations.parquet")
    return None if df is None else with_run_id(df, run)


def gates_of(realizations: DataFrame, keys: Sequence[str]) -> DataFrame:
    exploded = realizations.select(*keys, "t", F.posexplode("gates").alias("i", "_g"))
    return exploded.select(*keys, "t", "i", "_g.u", "_g.v", "_g.c")


def measurements_of(realizations: DataFrame, keys: Sequence[str]) -> DataFrame:
    return realizations.select(*keys, "t", F.explode("meas").alias("q"))


def nest_layers(gates: DataFrame, measured: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gate and measurement tables as one row per layer; a layer holds at most n entries."""
    at = [*keys, "t"]
    # one grouping of both tables: a join of two groupings is sized before the layers fan out and may broadcast a whole one
    entry = F.struct("i", "u", "v", "c")
    placed = gates.select(*at, entry.alias("_g")).unionByName(measured.select(*at, "q"), allowMissingColumns=True)
    nested = placed.groupBy(*at).agg(F.array_sort(F.collect_list("_g")).alias("_g"), F.sort_array(F.collect_list("q")).alias("meas"))
    pairs = F.transform("_g", lambda e: F.struct(e["u"].alias("u"), e["v"].alias("v"), e["c"].alias("c")))
    return nested.select(*at, pairs.alias("gates"), "meas")
