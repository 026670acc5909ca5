"""Run folders, the analysis runner, manifests and streaming over files."""

from __future__ import annotations

import json
import tempfile
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rategrid.catalog.base import CATALOG  # noqa: F401  (registers the built-in analyses)
from rategrid.functions import naming
from rategrid.plans import analyses, registry as reg, runner
from rategrid.sources import folders, manifest, records, runs, series
from rategrid.streaming import early_stop, ingest


@pytest.fixture(scope="module")
def run_dir():
    """Two sizes, two rates, three samples per cell; one analysis for size 8 only."""
    root = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "run-a"
    for n in (8, 12):
        for p in (0.0, 0.15):
            cell = root / "data" / f"n={n:04d}" / f"p={p:.4f}"
            (cell / "analysis").mkdir(parents=True)
            seeds = [40, 41, 42]
            pq.write_table(
                pa.table({"sample_seed": seeds, "obs.k": pa.array([0, 1, n], pa.int32()), "obs.p_k_gt_0": pa.array([0, 1, 1], pa.uint8())}),
                cell / "samples.parquet",
            )
            pq.write_table(pa.table({"sample_seed": seeds, "s": [[1, 0, 0], [1, 1, 1], [1, 1, 0]]}), cell / "timeseries.parquet")
            if n == 8:
                pq.write_table(pa.table({"sample_seed": seeds[:2], "d_cont": pa.array([1, 2], pa.int32())}), cell / "analysis" / "distances.parquet")
            pq.write_table(pa.table({"other": [1]}), cell / "analysis" / "keyless.parquet")
    (root / "manifest.json").write_text(json.dumps({"config": {"picture": "single_ref", "n": 8}}, indent=1))
    return str(root)


def test_load_run(spark, run_dir):
    df = runs.load_run(spark, run_dir, ["distances", "keyless", "absent"])
    assert df.count() == 12 and df.select("run_id").distinct().first()[0] == "run-a"
    assert dict(df.select("n", "p").dtypes) == {"n": "int", "p": "double"}
    assert df.where("obs.k > 0").count() == 8
    assert df.where("distances.d_cont is not null").count() == 4
    assert "keyless" not in df.columns and "absent" not in df.columns
    plan = df.where("n = 8")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(n" in plan


def test_load_many_runs_widens(spark, run_dir):
    both = runs.load_runs(spark, [run_dir, run_dir], ["distances"])
    assert both.count() == 24
    with pytest.raises(FileNotFoundError):
        runs.load_samples(spark, "/tmp/no-such-run")


def test_cells_and_flags(spark, run_dir):
    samples = runs.load_samples(spark, run_dir)
    assert runs.cells(samples, [8], [0.15 + 1e-12]).count() == 1
    index = {(r["n"], r["p"]): r for r in runs.cell_index(samples, samples.where("n = 8"), samples.where("p > 0")).collect()}
    assert index[8, 0.0]["has_tableau"] and not index[12, 0.0]["has_tableau"] and index[12, 0.15]["has_realization"]
    traces = series.load_traces(spark, run_dir)
    assert traces.count() == 12 and series.load_realizations(spark, run_dir) is None


def test_manifest(spark, run_dir):
    df = manifest.read_manifests(spark, [run_dir])
    assert manifest.require_same_picture(df, "single_ref").first()["picture"] == "single_ref"
    with pytest.raises(Exception, match="expected picture other"):
        manifest.require_same_picture(df, "other").collect()
    with pytest.raises(Exception, match="no readable picture"):
        manifest.require_picture(df.withColumn("manifest", F.lit("{}"))).collect()
    made = manifest.build_manifest(spark.createDataFrame([("r", 8, "complete", 3)], "run_id string, n int, picture string, n_workers int"), ["n", "picture"], ["n_workers"])
    assert manifest.require_picture(made).first()["picture"] == "complete"


def test_records(spark):
    folder = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    rows = [{"n": 8, "p": 0.1, "time": 1.5}, {"n": 8, "p": 0.1, "time": 0.0}, {"n": 8, "p": 0.1, "time": 2.0, "error": "x"}]
    (folder / "a.json").write_text(json.dumps(rows, indent=1))
    assert records.load_records(spark, str(folder / "a.json")).count() == 1
    assert records.load_records(spark, str(folder / "a.json"), time=None).count() == 3


def matrices(spark, cells):
    rows = []
    for n, p in cells:
        for seed in (1, 2):
            rows += [("r1", n, p, seed, i, i, 1, 0) for i in range(n)] + [("r1", n, p, seed, n + i, i, 0, 1) for i in range(n)]
    schema = "run_id string, n int, p double, sample_seed bigint, r int, q int, x int, z int"
    entries = spark.createDataFrame(rows, schema)
    dims = entries.select("run_id", "n", "p", "sample_seed").distinct().withColumn("n_cols", F.col("n")).withColumn("n_rows", 2 * F.col("n"))
    return entries, dims


def statuses(report):
    return {(r["n"], r["p"], r["analysis"]): r["status"] for r in report.collect()}


def test_runner_skips_fills_and_forces(spark):
    out = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    entries, dims = matrices(spark, [(4, 0.0), (6, 0.15)])
    samples = dims.select("run_id", "n", "p", "sample_seed", F.struct(F.col("n").alias("k")).alias("obs"))
    extra = samples.limit(1).withColumn("n", F.lit(9))
    known = samples.unionByName(extra)
    first = statuses(runner.run_analyses(spark, entries, dims, out, known, only=["distances", "weight_stats"], sizes=[4, 9]))
    assert first[4, 0.0, "distances"] == "computed" and {s for k, s in first.items() if k[0] == 9} == {"skipped"}
    report = runner.run_analyses(spark, entries, dims, out, samples, only=["distances", "logical_weights", "aggregates"], force=["logical_weights"])
    second = statuses(report)
    assert second[4, 0.0, "distances"] == "existing" and second[6, 0.15, "distances"] == "computed"
    assert second[4, 0.0, "aggregates"] == "computed"
    counts = {r["analysis"]: r.asDict() for r in reg.status_counts(report).collect()}
    assert counts["distances"]["existing"] == 1 and counts["distances"]["computed"] == 1
    found = runs.read_cells(spark, f"{out}/distances").collect()
    assert len(found) == 4 and {(r["d_cont"], r["d_min"]) for r in found} == {(1, 1)}
    logical = runs.read_cells(spark, f"{out}/logical_weights").collect()
    assert {(r["d_logical_x"], r["d_logical_y"], r["d_logical_z"]) for r in logical} == {(1, 1, 1)}
    cells = {r["n"]: r for r in spark.read.parquet(f"{out}/aggregates").collect()}
    assert cells[4]["distances.d_min_mean"] == 1.0 and cells[6]["k_over_n_mean"] == 1.0
    summary = json.loads(spark.read.json(f"{out}/{runner.SUMMARY}").first()["analysis_summary"])
    assert summary["run_level"] == ["aggregates"] and summary["per_cell"]["n=0006/p=0.1500"] == ["distances", "logical_weights"]
    entries_read = runner.read_registry(spark, out)
    assert entries_read.where("analysis = 'distances'").agg(F.sum("n_samples")).first()[0] == 4


def test_runner_isolates_failing_cells(spark):
    out = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    entries, dims = matrices(spark, [(4, 0.0), (6, 0.15)])

    def fussy(context, params):
        bad = F.when(F.col("n") == 6, F.raise_error(F.lit("size six")).cast("int")).otherwise(F.col("n"))
        return context.dims.select("run_id", "n", "p", "sample_seed", bad.alias("v"))

    reg.register_analysis(reg.Analysis("fussy", fussy))
    try:
        report = runner.run_analyses(spark, entries, dims, out, only=["fussy"])
    finally:
        del reg.ANALYSES["fussy"]
    assert statuses(report) == {(4, 0.0, "fussy"): "computed", (6, 0.15, "fussy"): "error"}
    assert "size six" in runner.errors(report).first()["message"]


def test_selection():
    assert [a.name for a in reg.select_analyses()][-1] == "aggregates"
    assert [a.name for a in reg.select_analyses(skip=["distances"], cheap=True)] == ["weight_stats", "entropy_profile", "weight_spectrum", "aggregates"]
    with pytest.raises(ValueError):
        reg.select_analyses(only=["a"], skip=["b"])
    assert reg.merged_params(reg.ANALYSES["aggregates"], {"aggregates": {"wilson_z": 2.0}})["wilson_z"] == 2.0


def test_names(spark):
    df = spark.createDataFrame([(32, 0.15, "p=0.1500", 0.12345, 0.01, "a_b{c}\\")], "n int, p double, part string, m double, e double, t string")
    row = df.select(
        naming.cell_path(F.col("n"), F.col("p")).alias("cell"),
        naming.partition_value(F.col("part")).alias("value"),
        naming.mean_pm_sem(F.col("m"), F.col("e")).alias("pm"),
        naming.mean_pm_sem(F.col("m"), F.lit(None).cast("double")).alias("m"),
        naming.tex_escape(F.col("t")).alias("tex"),
        naming.run_id(F.lit("2020-01-01"), F.lit("s"), F.lit(None), F.lit("{}")).alias("run"),
        naming.utc_stamp().alias("utc"),
    ).first()
    assert row["cell"] == "n=0032/p=0.1500" and row["value"] == "0.1500"
    assert row["pm"] == "0.123 ± 0.010" and row["m"] == "0.123"
    assert row["tex"] == "a\\_b\\{c\\}\\textbackslash\\{\\}" and row["run"].startswith("2020-01-01_s__")
    assert row["utc"].endswith("Z") and len(row["utc"]) == 20
    assert naming.condition_suffix("obs.k", ">= 1") == "obs_kgteq1" and naming.quantile_suffix(0.025) == "q025"


def test_early_stop_over_batches(spark):
    """A sample is reported once, in whichever batch its first zero arrives."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "n int, p double, sample_seed bigint, t bigint, s int"
    parts = [[(4, 0.1, 1, 0, 1), (4, 0.1, 2, 0, 1)], [(4, 0.1, 1, 1, 0), (4, 0.1, 2, 1, 1)], [(4, 0.1, 1, 2, 0), (4, 0.1, 2, 2, 1)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/part{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    rows = ingest.drain(early_stop.first_zeros(stream, cap=2), "test-first-zero").collect()
    assert sorted((r["sample_seed"], r["tau"], r["censored"]) for r in rows) == [(1, 1, False), (2, None, True)]


def test_gap_filling_stream(spark):
    folder, seen = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), []
    spark.createDataFrame([(8, 0.1), (8, 0.1), (12, 0.2)], "n int, p double").coalesce(1).write.parquet(f"{folder}/in")
    stream = ingest.file_stream(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema)
    ingest.fill_gaps(stream, lambda batch: seen.append(runs.cells(batch).count()), f"{folder}/journal").awaitTermination()
    assert seen == [2]


def test_one_scan_for_many_runs(spark, run_dir):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = [("run b+c", 8, 0.15, 40 + i, i) for i in range(3)] + [("x", 16, 0.5, 7, 1)]
    flat = spark.createDataFrame(rows, "run_id string, n int, p double, sample_seed bigint, k bigint")
    samples = flat.select("run_id", "n", "p", "sample_seed", F.col("k").alias("obs.k"))
    written = folders.write_run_folders(samples, root, "samples")
    folders.write_run_folders(flat.where("k > 0").select("run_id", "n", "p", "sample_seed", (F.col("k") * 1.5).alias("d_cont")), root, "analysis/distances")
    assert written == [f"{root}/run b+c", f"{root}/x"]
    everything = [run_dir, *written, "/tmp/no-such-run"]
    df = folders.scan_samples(spark, everything)
    assert {(r["run_id"], r["n"], r["p"]): r["count"] for r in df.where("n <> 12").groupBy("run_id", "n", "p").count().collect()} == {
        ("run-a", 8, 0.0): 3, ("run-a", 8, 0.15): 3, ("run b+c", 8, 0.15): 3, ("x", 16, 0.5): 1
    }
    assert df.schema["obs"].dataType["k"].dataType.typeName() == "long"  # int in one run, bigint in the others
    assert df.where("run_id = 'x'").agg(F.sum("obs.k"), F.count("obs.p_k_gt_0")).first()[:] == (1, 0)
    one = df.where("run_id = 'x' and n = 16").select("sample_seed")
    assert one.count() == len(one.collect()) == 1
    scan = one._jdf.queryExecution().executedPlan().collectLeaves()
    assert scan.size() == 1 and scan.head().metrics().get("numFiles").get().value() == 1  # other files are not opened
    found = folders.scan_analysis(spark, everything, "distances")
    assert {(r["run_id"], r["d"]) for r in found.selectExpr("run_id", "distances.d_cont AS d").collect()} == {
        ("run-a", 1.0), ("run-a", 2.0), ("run b+c", 1.5), ("run b+c", 3.0), ("x", 1.5)
    }
    assert folders.scan_analysis(spark, everything, "keyless") is None and folders.scan_analysis(spark, everything, "absent") is None
    assert folders.scan_traces(spark, everything).count() == 12
    with pytest.raises(FileNotFoundError):
        folders.scan_matrices(spark, everything)
    with pytest.raises(FileExistsError):
        folders.write_run_folders(samples, root, "samples")


def test_scanned_analyses_spread_by_rows(spark, tmp_path, monkeypatch):
    """Joins of run folders have partitions by rows, one shuffle for each side, and the rows of a plain join."""
    monkeypatch.setattr(folders, "ROWS_PER_TASK", 10)
    rows = [(f"r{i % 2}", 1, [0.0, 0.5, 0.25][i % 3], i, i) for i in range(300)]
    flat = spark.createDataFrame(rows, "run_id string, n int, p double, sample_seed long, k long")
    paths = folders.write_run_folders(flat, str(tmp_path), "samples")
    folders.write_run_folders(flat.where("k % 3 <> 1").selectExpr("run_id", "n", "p", "sample_seed", "k * 2 AS d"), str(tmp_path), "analysis/distances")
    whole = folders.attach_scanned(folders.scan_samples(spark, paths), {"distances": folders.scan_analysis(spark, paths, "distances")})
    assert whole.hint("merge").rdd.getNumPartitions() == 30
    assert {(r["sample_seed"], r["distances"] and r["distances"]["d"]) for r in whole.collect()} == {(i, None if i % 3 == 1 else 2 * i) for i in range(300)}
    plan = whole._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") <= 2
