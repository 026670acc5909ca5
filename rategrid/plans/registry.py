"""Which analyses exist, which are done, and what is left to compute."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ("run_id", "n", "p")
STATUSES = ("computed", "existing", "skipped", "error")


@dataclass(frozen=True)
class Analysis:
    """A plug-in: ``build(context, params)`` returns rows keyed by sample (or cell)."""

    name: str
    build: Callable[[Any, Mapping[str, Any]], DataFrame]
    default_params: Mapping[str, Any] = field(default_factory=dict)
    per_cell: bool = True
    expensive: bool = False


ANALYSES: dict[str, Analysis] = {}


def register_analysis(analysis: Analysis) -> Analysis:
    """Add a plug-in; order of registration is order of execution, run-level ones last."""
    ANALYSES[analysis.name] = analysis
    return analysis


def select_analyses(
    only: Iterable[str] | None = None, skip: Iterable[str] | None = None, cheap: bool = False
) -> list[Analysis]:
    """The chosen plug-ins in order; ``only`` and ``skip`` exclude each other."""
    if only and skip:
        raise ValueError("only and skip are mutually exclusive")
    only, skip = set(only or ()), set(skip or ())
    chosen = [
        a
        for a in ANALYSES.values()
        if (not only or a.name in only) and a.name not in skip and not (cheap and a.expensive)
    ]
    return [a for a in chosen if a.per_cell] + [a for a in chosen if not a.per_cell]


def merged_params(analysis: Analysis, params: Mapping[str, Mapping[str, Any]] | None) -> dict[str, Any]:
    return {**analysis.default_params, **((params or {}).get(analysis.name, {}))}


def latest_entries(
    registry: DataFrame, keys: Sequence[str] = (*CELL, "analysis"), order: Sequence[str] = ("computed_utc",)
) -> DataFrame:
    """The last entry per cell and analysis of an append-only registry.

    An aggregate, not a window: a pair with very many entries is combined map-side.
    """
    values = [c for c in registry.columns if c not in keys]
    last = F.max_by(F.struct(*values), F.struct(*order))
    return registry.groupBy(*keys).agg(last.alias("_e")).select(*keys, "_e.*")


def work_plan(
    cells: DataFrame,
    analyses: Sequence[str],
    registry: DataFrame,
    force: Iterable[str] = (),
    owned: DataFrame | None = None,
    keys: Sequence[str] = CELL,
) -> DataFrame:
    """Per wanted (cell, analysis): compute, existing, or skipped for lack of input.

    ``owned`` lists the cells that have matrices; without it every cell counts as ready.
    """
    keys = list(keys)
    named = F.explode(F.array(*[F.lit(a) for a in analyses])).alias("analysis")
    wanted = cells.select(*keys, named)
    done = registry.select(*keys, "analysis").distinct().withColumn("_done", F.lit(True))
    plan = wanted.join(done, [*keys, "analysis"], "left")
    if owned is not None:
        plan = plan.join(owned.select(*keys).distinct().withColumn("_ready", F.lit(True)), keys, "left")
    else:
        plan = plan.withColumn("_ready", F.lit(True))
    forced = F.col("analysis").isin(list(force)) if list(force) else F.lit(False)
    action = (
        F.when(F.col("_ready").isNull(), "skipped").when(F.col("_done") & ~forced, "existing").otherwise("compute")
    )
    return plan.select(*keys, "analysis", action.alias("action"))


def missing_work(plan: DataFrame) -> DataFrame:
    return plan.where("action = 'compute'").drop("action")


def status_counts(report: DataFrame) -> DataFrame:
    """Per analysis, the number of cells in each status."""
    return report.groupBy("analysis").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
