"""Many run folders at once: one scan per kind of table, whatever the number of runs.

The run, its size and its rate come from the path of each file (``_metadata.file_path``), so a filter on them prunes
files before any is opened (on the run only where no file stores a ``run_id`` of its own).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError  # the failed merge of footers reaches Python unconverted
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rategrid.functions.columns import fold_dotted
from rategrid.sources.runs import attach_analyses, union_runs

ROWS_PER_TASK = 500_000  # sample rows that one task of a join sorts or keeps
CELL_PATH = r"^(.*)/([^/]+)/data/n=([^/]+)/p=([^/]+)/"


def stored_paths(spark: SparkSession, runs: Sequence[str], pattern: str) -> list[str]:
    """The run folders' globs for one kind of table, without the runs that have no such file."""
    found = []
    for run in runs:
        glob = f"{run.rstrip('/')}/data/n=*/p=*/{pattern}"
        path = spark._jvm.org.apache.hadoop.fs.Path(glob)
        if len(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or ()) > 0:
            found.append(glob)
    return found


def _decoded(part: Column) -> Column:
    return F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))


def scan_runs(spark: SparkSession, runs: Sequence[str], pattern: str) -> DataFrame | None:
    """``run_id, n, p`` and the files' columns of one kind of table over all runs; None without files.

    Columns are the union over all files; one that a file lacks is null there.  Where the types of runs differ, they
    widen as in a union.  A stored ``run_id`` stands before the folder's name; folders of one name in different places
    are told apart by ``_source``.
    """
    paths = stored_paths(spark, runs, pattern)
    if not paths:
        return None
    reader = spark.read.option("recursiveFileLookup", "true")
    try:
        rows = reader.option("mergeSchema", "true").parquet(*paths)
    except Py4JJavaError as error:
        if "CANNOT_MERGE" not in str(error):
            raise
        # footers only: the scan itself is still one
        each = [reader.option("mergeSchema", "true").parquet(path) for path in paths]
        rows = reader.schema(union_runs(each).schema).parquet(*paths)
    place = F.col("_metadata.file_path")
    part = lambda i: F.regexp_extract(place, CELL_PATH, i)
    run = F.coalesce("run_id", _decoded(part(2))) if "run_id" in rows.columns else _decoded(part(2))
    values = [F.col(f"`{c}`") for c in rows.columns if c not in ("run_id", "n", "p")]
    source = F.concat_ws("/", part(1), part(2)).alias("_source")
    return rows.select(run.alias("run_id"), part(3).cast("int").alias("n"), part(4).cast("double").alias("p"), *values, source)


def _required(df: DataFrame | None, kind: str, runs: Sequence[str]) -> DataFrame:
    if df is None:
        raise FileNotFoundError(f"no {kind} under {list(runs)}")
    return df


def scan_samples(spark: SparkSession, runs: Sequence[str]) -> DataFrame:
    """Samples of all runs with folded columns."""
    return fold_dotted(_required(scan_runs(spark, runs, "samples.parquet"), "samples", runs))


def scan_analysis(spark: SparkSession, runs: Sequence[str], name: str, key: str = "sample_seed") -> DataFrame | None:
    """One analysis of all runs: key columns and a struct ``name``; None without files or without the sample key."""
    df = scan_runs(spark, runs, f"analysis/{name}.parquet")
    if df is None or key not in df.columns:
        return None
    keys = ["run_id", "n", "p", "_source", key]
    return df.select(*keys, F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keys]).alias(name))


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows with equal ``keys`` together, in partitions of about ``ROWS_PER_TASK`` if there are ``rows``.

    Bytes of a shuffle tell little: runs, cells and paths are compressed to next to nothing, but take their length in memory.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // ROWS_PER_TASK)), *keys)


def attach_scanned(samples: DataFrame, analyses: Mapping[str, DataFrame]) -> DataFrame:
    """Scanned samples left joined with scanned analyses; partitions grow in number with the rows, which footers count."""
    # rates as text (0 without sign): a join changes keys of type double, and would shuffle placed rows once more
    rate = (F.col("p") + 0.0).cast("string").alias("_rate")
    keys = ["run_id", "n", "_rate", "sample_seed", "_source"]
    rows = max(df.count() for df in (samples, *analyses.values()))
    placed = {name: spread(df.select("*", rate).drop("p"), rows, *keys) for name, df in analyses.items()}
    whole = attach_analyses(spread(samples.select("*", rate), rows, *keys), placed, keys)
    return whole.select(*[F.col(f"`{c}`") for c in (*samples.columns, *analyses)])


def scan_traces(spark: SparkSession, runs: Sequence[str]) -> DataFrame | None:
    """One row per sample with its array ``s``."""
    return scan_runs(spark, runs, "timeseries.parquet")


def scan_matrices(spark: SparkSession, runs: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Entries (``r, q, x, z``) and dims (``n_cols, n_rows``) of all runs' bit matrices."""
    entries, dims = (_required(scan_runs(spark, runs, f"{kind}.parquet"), kind, runs) for kind in ("entries", "dims"))
    return entries, dims


def write_run_folders(df: DataFrame, root: str, artefact: str) -> list[str]:
    """Write ``df(run_id, n, p, ...)`` as ``<root>/<run>/data/n=../p=../<artefact>.parquet``; returns the run folders.

    One job writes all cells beside the runs; then each cell's folder is renamed into place, one rename per cell of the
    sweep, so a reader never sees half a cell.  A cell that has the artefact already is an error.  ``analysis/`` may lead
    the artefact's name.
    """
    spark = df.sparkSession
    parked = f"{root.rstrip('/')}/_writing-{artefact.replace('/', '-')}"
    marked = df.withColumn("run", F.concat(F.lit("run-"), F.col("run_id"))).drop("run_id")  # a run id is never taken for a number
    cells = [F.col(c) for c in ("run", "n", "p")]
    marked.hint("rebalance", *cells).write.partitionBy("run", "n", "p").parquet(parked)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    top = path_of(parked)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    runs = []
    for status in files.globStatus(path_of(f"{parked}/run=*")):
        name = status.getPath().getName().removeprefix("run=run-")
        run = f"{root.rstrip('/')}/{name}"
        for cell in files.globStatus(path_of(f"{parked}/run=run-{name}/n=*/p=*")):
            place = cell.getPath()
            target = path_of(f"{run}/data/{place.getParent().getName()}/{place.getName()}/{artefact}.parquet")
            files.mkdirs(target.getParent())
            if files.exists(target) or not files.rename(place, target):
                raise FileExistsError(str(target))
        runs.append(run)
    files.delete(top, True)
    return sorted(runs)
