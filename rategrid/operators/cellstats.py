"""Per-cell statistics of many columns in one pass, plain and under a condition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rategrid.functions.aliases import with_rollup_aliases
from rategrid.functions.columns import attach_summary, join_on, leaves, numeric_columns, require_column
from rategrid.functions.intervals import Z_DEFAULT, binary_integer, wilson_bounds
from rategrid.functions.naming import condition_suffix, quantile_suffix
from rategrid.functions.numeric import NAN, finite, skip_nan
from rategrid.functions.predicates import condition_or_nothing
from rategrid.operators.quantiles import Cuts, quantiles_of_parts
from rategrid.session import cut_lineage

QUANTILES = (0.025, 0.5, 0.975)
INTEGER_TYPES = ("byte", "short", "integer", "long")


def aggregate_entropy(df: DataFrame, column: str = "obs.k", keys: Sequence[str] = ("n", "p")) -> DataFrame:
    """Mean, sample deviation, count and standard error of one column per cell."""
    require_column(df, column)
    value = F.col(column)
    spread, size = F.stddev_samp(value), F.count(value)
    return (
        df.groupBy(*keys)
        .agg(F.avg(value).alias("S_mean"), spread.alias("S_std"), size.alias("count"))
        .withColumn("S_sem", F.when(F.col("count") > 0, F.col("S_std") / F.sqrt(F.col("count").cast("double"))))
        .orderBy(*keys)
    )


def _moments(name: str, value: Column, rows: Column, keep: Column, suffix: str) -> list[Column]:
    """mean, std and sem of one column over ``rows`` rows, as the rollup defines them."""
    v = skip_nan(value)
    spread = F.when(rows > 1, F.coalesce(F.stddev_samp(v), F.lit(NAN))).otherwise(F.lit(0.0))
    error = F.when((rows > 1) & ~F.isnan(spread), spread / F.sqrt(rows.cast("double"))).otherwise(F.lit(0.0))
    named = {"mean": F.coalesce(F.avg(v), F.lit(NAN)), "std": spread, "sem": error}
    return [F.when(keep, c).alias(f"{name}_{stat}{suffix}") for stat, c in named.items()]


def _wilson(name: str, value: Column, z: float, suffix: str) -> list[Column]:
    low, high = wilson_bounds(F.sum(value), F.count(value), z)
    flag = binary_integer(value)
    return [
        F.when(flag, low).alias(f"{name}_wilson_lower{suffix}"),
        F.when(flag, high).alias(f"{name}_wilson_upper{suffix}"),
    ]


def cell_rollup(
    df: DataFrame,
    keys: Sequence[str] = ("n", "p"),
    columns: Sequence[str] | None = None,
    quantiles: Sequence[float] = QUANTILES,
    z: float = Z_DEFAULT,
    condition_column: str = "obs.k",
    condition_text: str = "> 0",
    quantile_method: str = "exact",
) -> DataFrame:
    """One wide row per cell: every statistic of every numeric column, also conditionally.

    Statistics come from one aggregation.  Exact quantiles use the split recipe of
    :mod:`rategrid.operators.quantiles`; ``quantile_method="sketch"`` keeps them in the
    same aggregation as ``percentile_approx``; an empty ``quantiles`` skips them.
    """
    keys = list(keys)
    df = with_rollup_aliases(df)
    predicate = condition_or_nothing(df, condition_column, condition_text)
    kinds = {path: kind.typeName() for path, kind in leaves(df.schema)}
    names = list(columns) if columns is not None else [c for c in numeric_columns(df) if c not in keys]
    rows, rows_cond = F.count(F.lit(1)), F.count(F.when(predicate, F.lit(1)))
    always, some = F.lit(True), rows_cond > 0
    count_cond = f"n_samples_cond_{condition_suffix(condition_column, condition_text)}"

    stats: list[Column] = [rows.alias("n_samples"), rows_cond.alias(count_cond)]
    for name in names:
        value, value_cond = F.col(name), F.when(predicate, F.col(name))
        stats += _moments(name, value, rows, always, "") + _moments(name, value_cond, rows_cond, some, "_cond")
        if kinds[name] in INTEGER_TYPES:
            stats += _wilson(name, value, z, "") + _wilson(name, value_cond, z, "_cond")
        if quantile_method == "sketch" and quantiles:
            for v, keep, suffix in ((value, always, ""), (value_cond, some, "_cond")):
                marks = F.percentile_approx(finite(v), [float(q) for q in quantiles], 10_000)
                for i, q in enumerate(quantiles):
                    stats.append(
                        F.when(keep, F.coalesce(marks[i], F.lit(NAN))).alias(f"{name}_{quantile_suffix(q)}{suffix}")
                    )
    if quantile_method == "exact" and quantiles:
        # the sketches that place the cuts share the pass of the moments
        plan = Cuts(quantiles)
        slots = [v for name in names for v in (F.col(name), F.when(predicate, F.col(name)))]
        stats += [plan.sketch(finite(v)).alias(f"_cuts_{i}") for i, v in enumerate(slots)]
        cells = cut_lineage(df.groupBy(*keys).agg(*stats))
        cells = _with_exact_quantiles(df, cells, keys, names, slots, plan, count_cond)
    else:
        cells = df.groupBy(*keys).agg(*stats)
    return cells.orderBy(*keys)


def _with_exact_quantiles(
    df: DataFrame,
    cells: DataFrame,
    keys: list[str],
    names: list[str],
    slots: Sequence[Column],
    plan: Cuts,
    count_cond: str,
) -> DataFrame:
    """Quantile columns from the cuts in ``cells`` and one more pass over the rows."""
    quantiles = plan.qs
    places = [F.struct(F.lit(i).alias("slot"), F.col(f"_cuts_{i}").alias("_cuts")) for i in range(len(slots))]
    cuts = cells.select(*keys, F.inline(F.array(*places))).where(F.col("_cuts").isNotNull())
    values = [F.struct(F.lit(i).alias("slot"), finite(v).alias("_v")) for i, v in enumerate(slots)]
    melted = df.select(*keys, F.inline(F.array(*values))).where(F.col("_v").isNotNull())
    own = [*keys, "slot"]
    placed = attach_summary(melted, cuts, own)
    parted = placed.select(*own, "_v", plan.part(F.col("_v"), F.col("_cuts")).alias("_part"))
    found = quantiles_of_parts(parted, own, plan)
    cells = cells.drop(*[f"_cuts_{i}" for i in range(len(slots))])
    # at most two rows per column and cell
    by_cell = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("slot", "quantiles"))).alias("_q"))
    joined = join_on(cells, by_cell, keys, "left")
    extra = []
    for i, name in enumerate(names):
        for slot, suffix in ((2 * i, ""), (2 * i + 1, "_cond")):
            for j, q in enumerate(quantiles):
                mark = F.coalesce(F.col("_q")[F.lit(slot)][j], F.lit(NAN))
                if suffix:
                    mark = F.when(F.col(f"`{count_cond}`") > 0, mark)
                extra.append(mark.alias(f"{name}_{quantile_suffix(q)}{suffix}"))
    kept = [F.col(f"`{c}`") for c in cells.columns]
    return joined.select(*kept, *extra)


def tidy(cells: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Wide cell rows as (keys, statistic, value) rows."""
    names = list(columns) if columns else [c for c in cells.columns if c not in keys]
    pairs = F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(f"`{c}`").cast("double").alias("value")) for c in names])
    return cells.select(*keys, F.explode(pairs).alias("_s")).select(*keys, "_s.statistic", "_s.value")


def progress(df: DataFrame, keys: Sequence[str] = ("n", "p")) -> DataFrame:
    """Per cell: mean k, mean final abar and mean runtime."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg("obs.k").alias("mean_k"),
        F.avg("diag.final_abar").alias("mean_abar"),
        F.avg("diag.runtime_total_s").alias("mean_runtime_s"),
    )
