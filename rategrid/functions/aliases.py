"""Derived columns that are added on demand from SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rategrid.functions.columns import has_column

# name -> (source column, SQL text)
DERIVED_ALIASES: dict[str, tuple[str, str]] = {
    "k_over_n": ("obs.k", "cast(obs.k as double) / cast(n as double)"),
    "d_cont_over_n": ("distances.d_cont", "cast(distances.d_cont as double) / cast(n as double)"),
    "d_min_over_n": ("distances.d_min", "cast(distances.d_min as double) / cast(n as double)"),
    "d_logical_min_over_n": (
        "logical_weights.d_logical_min",
        "cast(logical_weights.d_logical_min as double) / cast(n as double)",
    ),
}

# the aliases that a cell rollup adds by itself
ROLLUP_ALIASES = ("k_over_n", "d_cont_over_n", "d_min_over_n")


def register_alias(name: str, source: str, sql: str) -> None:
    DERIVED_ALIASES[name] = (source, sql)


def ensure_column(df: DataFrame, name: str) -> DataFrame:
    """Add the derived column ``name`` if it is missing and known; else leave ``df`` as is."""
    if has_column(df, name) or name not in DERIVED_ALIASES:
        return df
    source, sql = DERIVED_ALIASES[name]
    if not has_column(df, source):
        return df
    return df.withColumn(name, F.expr(sql))


def with_rollup_aliases(df: DataFrame) -> DataFrame:
    for name in ROLLUP_ALIASES:
        df = ensure_column(df, name)
    return df
