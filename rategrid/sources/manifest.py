"""Run manifests as JSON text: reading, the picture field, and building new ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rategrid.functions.naming import cell_path

# Where a manifest may hold its picture, in order of preference.
PICTURE_PATHS = ("$.config.picture", "$.circuit_config.picture", "$.circuit.picture", "$.picture")
SCHEMA_VERSION = "1.0.0"


def read_manifests(spark: SparkSession, runs: Sequence[str]) -> DataFrame:
    """``(run_id, manifest)`` for many run folders in one scan."""
    paths = [run.rstrip("/") + "/manifest.json" for run in runs]
    text = spark.read.text(paths, wholetext=True)
    folder = F.regexp_extract(F.input_file_name(), "([^/]+)/manifest[.]json$", 1)
    return text.select(folder.alias("run_id"), F.col("value").alias("manifest"))


def picture(manifest: Column) -> Column:
    """The first picture that is a JSON string; null if there is none or the text is broken."""
    parsed = F.try_parse_json(manifest)
    found = []
    for path in PICTURE_PATHS:
        node = F.try_variant_get(parsed, path, "variant")
        found.append(F.when(F.schema_of_variant(node) == "STRING", F.try_variant_get(parsed, path, "string")))
    return F.coalesce(*found)


def require_picture(df: DataFrame, column: str = "manifest") -> DataFrame:
    """Add ``picture``; a manifest without one fails the job with its run id."""
    message = F.concat(F.lit("no readable picture in the manifest of run "), F.col("run_id"))
    return df.withColumn("picture", F.coalesce(picture(F.col(column)), F.raise_error(message).cast("string")))


def require_same_picture(df: DataFrame, expected: str) -> DataFrame:
    """Keep the runs; fail if one was made with another picture."""
    message = F.concat(F.lit(f"expected picture {expected}, run "), F.col("run_id"), F.lit(" has "), F.col("picture"))
    checked = F.when(F.col("picture") == expected, F.col("picture")).otherwise(F.raise_error(message).cast("string"))
    return require_picture(df).withColumn("picture", checked)


def build_manifest(runs: DataFrame, config: Sequence[str], runtime: Sequence[str]) -> DataFrame:
    """Manifest text per run from plain columns: ``config`` and ``runtime`` name the nested parts."""
    body = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.col("run_id"),
        F.struct(*config).alias("config"),
        F.struct(*runtime).alias("runtime"),
    )
    return runs.select("run_id", F.to_json(body).alias("manifest"))


def analysis_summary(cells: DataFrame, finished: DataFrame, run_level: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Per run: finished analyses of every cell, and the run-level ones, as JSON.

    One entry per cell: bounded by the sweep's grid.
    """
    keys = list(keys)
    done = finished.groupBy(*keys, "n", "p").agg(F.sort_array(F.collect_set("analysis")).alias("_a"))
    none = F.array().cast("array<string>")
    per_cell = cells.join(done, [*keys, "n", "p"], "left").select(
        *keys, F.struct(cell_path(F.col("n"), F.col("p")).alias("cell"), F.coalesce(F.col("_a"), none).alias("analyses")).alias("_c")
    )
    gathered = per_cell.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list("_c"))).alias("per_cell"))
    runs = run_level.groupBy(*keys).agg(F.sort_array(F.collect_set("analysis")).alias("_r"))
    joined = gathered.join(runs, keys, "left")
    summary = F.struct(F.col("per_cell"), F.coalesce(F.col("_r"), none).alias("run_level"))
    return joined.select(*keys, F.to_json(summary).alias("analysis_summary"))
