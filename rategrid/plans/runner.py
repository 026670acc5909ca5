"""Compute the missing analyses of a sweep and record what was done."""

from __future__ import annotations

import time
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rategrid import __version__
from rategrid.functions.naming import utc_stamp
from rategrid.functions.predicates import rate_in, size_in
from rategrid.plans.analyses import Context
from rategrid.plans.registry import CELL, Analysis, latest_entries, merged_params, missing_work, select_analyses, work_plan
from rategrid.session import cut_lineage
from rategrid.sources.manifest import analysis_summary
from rategrid.sources.runs import read_cells, write_cells

REGISTRY = "_registry"
SUMMARY = "_summary"
REGISTRY_SCHEMA = (
    "run_id string, n int, p double, analysis string, computed_utc string, package_version string,"
    " git_hash string, git_dirty boolean, params map<string,string>, runtime_s double, n_samples bigint"
)
REPORT_SCHEMA = "run_id string, n int, p double, analysis string, status string, message string"

# analyses over reduced row spaces
NEED_SPACES = ("distances", "entropy_profile", "logical_weights")


def read_registry(spark: SparkSession, out: str) -> DataFrame:
    """Latest entry per cell and analysis; empty before the first run."""
    try:
        return latest_entries(spark.read.parquet(f"{out}/{REGISTRY}"))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], REGISTRY_SCHEMA)


def _record(todo: DataFrame, dims: DataFrame, analysis: Analysis, params: Mapping[str, Any], seconds: float, out: str) -> None:
    counted = dims.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_samples"))
    texts = [F.lit(str(part)) for item in params.items() for part in item]
    entries = todo.select(*CELL).distinct().join(counted, list(CELL), "left").select(
        *CELL,
        F.lit(analysis.name).alias("analysis"),
        utc_stamp().alias("computed_utc"),
        F.lit(__version__).alias("package_version"),
        F.lit(None).cast("string").alias("git_hash"),
        F.lit(None).cast("boolean").alias("git_dirty"),
        F.create_map(*texts).cast("map<string,string>").alias("params"),
        F.lit(seconds).alias("runtime_s"),
        F.coalesce("n_samples", F.lit(0)).cast("bigint").alias("n_samples"),
    )
    entries.write.mode("append").parquet(f"{out}/{REGISTRY}")


def _compute(context: Context, analysis: Analysis, params: Mapping[str, Any], cells: DataFrame, out: str) -> None:
    start = time.time()
    write_cells(analysis.build(context.limited(cells), params), f"{out}/{analysis.name}", "overwrite")
    _record(cells, context.dims, analysis, params, time.time() - start, out)


def _with_status(plan: DataFrame, failed: Sequence[tuple]) -> DataFrame:
    spark = plan.sparkSession
    status = F.when(F.col("action") == "compute", "computed").otherwise(F.col("action"))
    report = plan.select(*CELL, "analysis", status.alias("status"), F.lit("").alias("message"))
    if not failed:
        return report
    bad = spark.createDataFrame(failed, REPORT_SCHEMA)
    return report.join(bad, [*CELL, "analysis"], "left_anti").unionByName(bad)


def run_analyses(
    spark: SparkSession,
    entries: DataFrame,
    dims: DataFrame,
    out: str,
    samples: DataFrame | None = None,
    only: Iterable[str] | None = None,
    skip: Iterable[str] | None = None,
    force: Iterable[str] = (),
    params: Mapping[str, Mapping[str, Any]] | None = None,
    sizes: Iterable[int] | None = None,
    rates: Sequence[float] | None = None,
) -> DataFrame:
    """Fill the gaps of ``out`` and return a report ``(cell, analysis, status, message)``.

    Each analysis is one distributed job over all cells it still has to do.  If that job
    fails, its cells are tried one by one so that only the failing ones are reported.
    Run-level analyses are always recomputed, after the others.
    """
    out = out.rstrip("/")
    chosen = select_analyses(only, skip)
    per_cell = [a for a in chosen if a.per_cell]
    known = dims if samples is None else samples
    cells = known.select(*CELL).where(size_in(sizes)).where(rate_in(rates)).distinct()
    reports: list[DataFrame] = []
    context = Context(entries, dims, samples)
    if per_cell:
        plan = work_plan(cells, [a.name for a in per_cell], read_registry(spark, out), force, dims)
        # fixed now: the registry grows while the jobs run
        plan = cut_lineage(plan)
        todo = missing_work(plan)
        context = context.limited(todo)
        needed = [a.name for a in per_cell if a.name in NEED_SPACES]
        if needed and not todo.where(F.col("analysis").isin(*needed)).isEmpty():
            _share_spaces(context)
        for analysis in per_cell:
            own = todo.where(F.col("analysis") == analysis.name)
            failed: list[tuple] = []
            if not own.isEmpty():
                failed = _attempt(context, analysis, merged_params(analysis, params), own, out)
            reports.append(_with_status(plan.where(F.col("analysis") == analysis.name), failed))
            done = read_cells(spark, f"{out}/{analysis.name}")
            if done is not None:
                context.outputs[analysis.name] = done
    for analysis in chosen:
        if analysis.per_cell:
            continue
        whole = cells.select(*CELL, F.lit(analysis.name).alias("analysis"), F.lit("compute").alias("action"))
        if samples is None:  # statistics of samples need samples
            reports.append(_with_status(whole.withColumn("action", F.lit("skipped")), []))
            continue
        failed = []
        for name in ("distances", "weight_stats", "logical_weights"):
            stored = read_cells(spark, f"{out}/{name}")
            if stored is not None:
                context.outputs[name] = stored
        try:
            result = analysis.build(Context(entries, dims, samples, context.outputs), merged_params(analysis, params))
            result.write.mode("overwrite").parquet(f"{out}/{analysis.name}")
        except Exception as error:
            failed = [(*row, analysis.name, "error", _text(error)) for row in cells.collect()]
        reports.append(_with_status(whole, failed))
    _write_summary(spark, known.select(*CELL).distinct(), [a.name for a in chosen if not a.per_cell], out)
    report = reports[0]
    for part in reports[1:]:
        report = report.unionByName(part)
    return report


def _write_summary(spark: SparkSession, cells: DataFrame, run_level: Sequence[str], out: str) -> None:
    """Per run, the finished analyses of every cell as JSON, next to the outputs."""
    names = F.explode(F.array(*[F.lit(a) for a in run_level]).cast("array<string>")).alias("analysis")
    summary = analysis_summary(cells, read_registry(spark, out), cells.select("run_id").distinct().select("run_id", names))
    summary.write.mode("overwrite").json(f"{out}/{SUMMARY}")


def _attempt(context: Context, analysis: Analysis, params: Mapping[str, Any], own: DataFrame, out: str) -> list[tuple]:
    """Compute the cells of ``own``; a failure halves them until the failing ones stand alone.

    One failing cell among n costs about 2 log2(n) further jobs, not n.
    """
    try:
        _compute(context, analysis, params, own, out)
        return []
    except Exception as error:
        cells = own.select(*CELL).distinct()
        rows = [tuple(c) for c in cells.collect()]
        if len(rows) == 1:
            return [(*rows[0], analysis.name, "error", _text(error))]
    failed = []
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        some = own.sparkSession.createDataFrame(part, cells.schema)
        failed += _attempt(context, analysis, params, own.join(some, list(CELL), "left_semi"), out)
    return failed


def _text(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def _share_spaces(context: Context) -> None:
    """Build the row spaces once for all analyses of the run; a failure shows up in each analysis that needs them."""
    try:
        _ = context.spaces
    except Exception:
        context.__dict__.pop("spaces", None)


def errors(report: DataFrame) -> DataFrame:
    return report.where("status = 'error'")
