"""Reading and writing runs: samples, per-analysis tables, cells and the cell index.

A run folder holds ``data/n=<size>/p=<rate>/samples.parquet`` and, per cell,
``analysis/<name>.parquet``.  Tables written by this package use one dataset per kind,
``<kind>/run=<run>/n=<size>/p=<rate>/``, so that nothing mixes schemas.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rategrid.functions.columns import fold_dotted
from rategrid.functions.predicates import rate_in, size_in

SAMPLE_KEY = ("run_id", "n", "p", "sample_seed")


def run_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def read_glob(spark: SparkSession, run: str, pattern: str) -> DataFrame | None:
    """Parquet files below ``<run>/data`` with their partition columns; None without files.

    Columns are the union over all files: a column that only some cells have is null in the others.
    """
    root = run.rstrip("/") + "/data"
    try:
        return spark.read.option("basePath", root).option("mergeSchema", "true").parquet(f"{root}/{pattern}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def load_samples(spark: SparkSession, run: str) -> DataFrame:
    """Every sample of one run, with ``run_id``, ``n``, ``p`` and folded columns."""
    df = read_glob(spark, run, "n=*/p=*/samples.parquet")
    if df is None:
        raise FileNotFoundError(f"no samples under {run}")
    return with_run_id(fold_dotted(df), run)


def with_run_id(df: DataFrame, run: str) -> DataFrame:
    if "run_id" in df.columns:
        return df
    return df.select(F.lit(run_name(run)).alias("run_id"), "*")


def load_analysis(spark: SparkSession, run: str, name: str, key: str = "sample_seed") -> DataFrame | None:
    """One analysis of a run: key columns plus a struct ``name`` of its other columns.

    None if no cell has the file or the files do not carry the sample key.
    """
    df = read_glob(spark, run, f"n=*/p=*/analysis/{name}.parquet")
    if df is None or key not in df.columns:
        return None
    values = [c for c in df.columns if c not in ("n", "p", key)]
    return df.select(F.lit(run_name(run)).alias("run_id"), "n", "p", key, F.struct(*values).alias(name))


def attach_analyses(
    samples: DataFrame, analyses: Mapping[str, DataFrame], keys: Sequence[str] = SAMPLE_KEY
) -> DataFrame:
    """Left join every analysis on the sample key; unmatched samples keep nulls.

    All joins share one key, so the samples are shuffled once for all of them; AQE splits
    a skewed key on the samples side.
    """
    return reduce(lambda df, name: df.join(analyses[name], list(keys), "left"), analyses, samples)


def stored_analyses(spark: SparkSession, run: str) -> list[str]:
    """Names of the analyses that any cell of the run has."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(run.rstrip("/") + "/data/n=*/p=*/analysis/*.parquet")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted({status.getPath().getName().removesuffix(".parquet") for status in found or ()})


def load_run(spark: SparkSession, run: str, analyses: Iterable[str] | None = None) -> DataFrame:
    return load_runs(spark, run, analyses)


def load_matrices(spark: SparkSession, runs: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Stored bit matrices of runs: entries (``r, q, x, z``) and dims (``n_cols, n_rows``) by sample.

    A cell holds ``entries.parquet`` and ``dims.parquet`` beside its samples.
    """
    paths = [runs] if isinstance(runs, str) else list(runs)
    tables = []
    for kind in ("entries", "dims"):
        parts = [(p, read_glob(spark, p, f"n=*/p=*/{kind}.parquet")) for p in paths]
        found = [with_run_id(df, p) for p, df in parts if df is not None]
        if not found:
            raise FileNotFoundError(f"no {kind} under {paths}")
        tables.append(union_runs(found))
    return tables[0], tables[1]


def union_runs(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of several runs; missing columns become null and types widen."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def load_runs(
    spark: SparkSession, sources: str | Sequence[str], analyses: Iterable[str] | None = None
) -> DataFrame:
    """Samples of one or more runs with their analyses: the named ones, or all that are stored.

    Runs are united before the joins, so there is one join per analysis however many runs there are.
    """
    paths = [sources] if isinstance(sources, str) else list(sources)
    place = "_source"  # runs of one name in different folders stay apart
    samples = union_runs([load_samples(spark, p).withColumn(place, F.lit(i)) for i, p in enumerate(paths)])
    named = [stored_analyses(spark, p) if analyses is None else list(analyses) for p in paths]
    tables = {}
    for name in dict.fromkeys(n for names in named for n in names):
        parts = [(i, load_analysis(spark, p, name)) for i, p in enumerate(paths) if name in named[i]]
        found = [df.withColumn(place, F.lit(i)) for i, df in parts if df is not None]
        if found:
            tables[name] = union_structs(found, name, [*SAMPLE_KEY, place])
    return attach_analyses(samples, tables, [*SAMPLE_KEY, place]).drop(place)


def union_structs(parts: Sequence[DataFrame], name: str, keys: Sequence[str]) -> DataFrame:
    """Union of analysis tables whose structs may have different fields."""
    flat = [df.select(*[c for c in df.columns if c != name], f"{name}.*") for df in parts]
    whole = union_runs(flat)
    return whole.select(*keys, F.struct(*[c for c in whole.columns if c not in keys]).alias(name))


def cells(
    df: DataFrame,
    sizes: Iterable[int] | None = None,
    rates: Sequence[float] | None = None,
    keys: Sequence[str] = ("n", "p"),
) -> DataFrame:
    """The distinct cells, filtered by size set and rate list; reads only partition columns."""
    return df.select(*keys).where(size_in(sizes)).where(rate_in(rates)).distinct()


def cell_flags(cells_df: DataFrame, artefacts: Mapping[str, DataFrame], keys: Sequence[str] = ("n", "p")) -> DataFrame:
    """One boolean per artefact: does the cell own rows of that table?"""
    out = cells_df
    for flag, table in artefacts.items():
        owned = table.select(*keys).distinct().withColumn(flag, F.lit(True))
        out = out.join(owned, list(keys), "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    return out


def cell_index(
    samples: DataFrame, matrices: DataFrame, realizations: DataFrame, keys: Sequence[str] = ("n", "p")
) -> DataFrame:
    """One row per cell: sample count and which side tables it owns."""
    counted = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"))
    return cell_flags(counted, {"has_tableau": matrices, "has_realization": realizations}, keys)


def write_cells(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write a table partitioned by run and cell; ``overwrite`` replaces only the cells in ``df``.

    Rows are rebalanced by cell: adaptive execution splits a cell with a large share of all
    rows over several tasks and keeps small cells in one file.  The run folder carries a
    prefix, so that Spark never takes a run id for a number.
    """
    parts = ["run", "n", "p"]
    (
        df.withColumn("run", F.concat(F.lit("run-"), F.col("run_id")))
        .hint("rebalance", *[F.col(c) for c in parts])
        .write.partitionBy(*parts)
        .option("partitionOverwriteMode", "dynamic")
        .mode(mode)
        .parquet(path)
    )


def read_cells(spark: SparkSession, path: str) -> DataFrame | None:
    """A table written by :func:`write_cells`; None if there is none yet."""
    try:
        return spark.read.parquet(path).drop("run")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
