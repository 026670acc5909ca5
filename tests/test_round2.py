"""Runs kept apart, null and hot keys, gaps, precision, discovery and shrinking."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from rategrid.functions.columns import attach_summary
from rategrid.functions.words import RowSpace, to_words
from rategrid.operators import bootstrap, curve, quantiles, survival
from rategrid.operators.distances import irreducible
from rategrid.operators.gf2 import row_spaces
from rategrid.sources import runs
from rategrid.streaming import early_stop, ingest, running


@pytest.fixture(scope="module")
def two_runs(spark):
    rows = [(r, 8, 0.1, 1, t, 1 if t < 3 + i else 0) for i, r in enumerate(("a", "b")) for t in range(6)]
    return spark.createDataFrame(rows, "run_id string, n int, p double, sample_seed long, t long, s int")


def test_runs_with_equal_seeds(two_runs):
    band = {r["t"]: r for r in survival.survival_band(two_runs).collect()}
    assert band[0]["mean_s"] == 1.0 and band[0]["n_samples"] == 2 and max(r["mean_s"] for r in band.values()) <= 1
    row = survival.tau_table(two_runs).first()
    assert row["n_total"] == 2 and row["tau_mean"] == 3.5


def test_crossing_over_a_gap(spark):
    points = spark.createDataFrame([(8, 0.1, 0, 1.0), (8, 0.1, 10, 0.2)], "n int, p double, t long, mean_s double")
    assert survival.crossing_time(points, 0.5).first()["tau_interp"] == pytest.approx(6.25)


def test_early_stop_per_run(spark, two_runs, tmp_path):
    folder = str(tmp_path / "in")
    two_runs.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(two_runs.schema).parquet(folder)
    found = ingest.drain(early_stop.first_zeros(stream, cap=9), "two-runs").collect()
    assert sorted((r["run_id"], r["tau"]) for r in found) == [("a", 3), ("b", 4)]


def test_running_deviation_far_from_zero(spark):
    rows = spark.createDataFrame([(1, 0.1, 1e9 + i) for i in range(3)], "n int, p double, v double")
    assert running.finish(running.running_cells(rows, "v")).first()["S_std"] == pytest.approx(1.0)


@pytest.fixture(scope="module")
def nullable(spark):
    rows = [(None, 1.0 + i % 5) for i in range(20)] + [(0.5, 2.0 + i % 3) for i in range(12)]
    return spark.createDataFrame(rows, "p double, y double")


def test_null_group_stays(nullable):
    medians = {r["p"]: r["median"] for r in quantiles.exact_median(nullable, ["p"], "y").collect()}
    assert medians == {None: 3.0, 0.5: 3.0}
    bars = {r["p"]: r for r in bootstrap.bootstrap_interval(nullable, ["p"], "y").collect()}
    assert bars[None]["err_high"] > 0
    data = nullable.withColumn("n", F.lit(8))
    means = {r["p"]: r for r in curve.aggregate_curve(data, "y", "p", "ci95").collect()}
    assert means[None]["err_low"] > 0


def test_hot_key_takes_all_salts(spark):
    big = spark.range(4000).select(F.lit("hot").alias("k"), (F.col("id") % 2).alias("v"), F.create_map(F.lit(1), F.lit(2)).alias("m"))
    big = big.unionByName(spark.range(10).select(F.lit(None).cast("string").alias("k"), F.lit(7).cast("long").alias("v"), F.create_map(F.lit(1), F.lit(2)).alias("m")))
    summary = big.groupBy("k").agg(F.count(F.lit(1)).alias("rows"))
    joined = attach_summary(big, summary, ["k"], max_broadcast_bytes=0, salts=8)
    assert joined.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.max("rows").alias("r")).filter("c <> r").count() == 0
    assert joined.count() == 4010


def test_bootstrap_in_blocks(spark):
    rows = spark.range(3000).select(F.lit(1).alias("p"), (F.col("id") % 997).cast("double").alias("y"))
    split = bootstrap.bootstrap_interval(rows, ["p"], "y", chunk_values=20).first()
    sem = rows.agg((F.stddev_samp("y") / F.sqrt(F.count("y"))).alias("s")).first()["s"]
    assert abs(split["err_low"] - 1.96 * sem) < 0.25 * sem and abs(split["err_high"] - 1.96 * sem) < 0.25 * sem


def test_many_matrices_keep_bases_small(spark):
    generator = random.Random(3)
    rows = [(m, [generator.getrandbits(8), generator.getrandbits(8)]) for m in range(20) for _ in range(200)]
    packed = spark.createDataFrame(rows, "m int, words array<long>")
    dims = spark.range(20).select(F.col("id").cast("int").alias("m"), F.lit(8).alias("n_cols"))
    sizes = [len(r["rref"]) for r in row_spaces(packed, dims, ["m"]).collect()]
    assert len(sizes) == 20 and max(sizes) <= 16


def test_irreducible_core():
    generator = random.Random(5)
    seen = 0
    for _ in range(60):
        n = 8
        rows = [generator.getrandbits(n) | generator.getrandbits(n) << 64 for _ in range(10)]
        basis: list[int] = []
        from rategrid.functions.words import reduced

        found = reduced(iter(rows))
        basis = [to_words(found[p], 2) for p in sorted(found)]
        space = RowSpace(basis, n)
        members = list(range(n))
        if not space.informative(members):
            continue
        seen += 1
        core = irreducible(space, members)
        assert space.informative(core)
        assert not any(space.informative([c for c in core if c != q]) for q in core)
    assert seen


def test_schema_union_and_discovery(spark, tmp_path):
    run = str(tmp_path / "run-a")
    for p, extra in ((0.1, ""), (0.2, ", 5 AS b")):
        cell = f"{run}/data/n=8/p={p}"
        spark.sql(f"SELECT 1L AS sample_seed, 2 AS k{extra}").write.parquet(f"{cell}/samples.parquet")
        spark.sql(f"SELECT 1L AS sample_seed, 3 AS d_cont{extra}").write.parquet(f"{cell}/analysis/distances.parquet")
        spark.sql("SELECT 1L AS sample_seed, 0 AS r, 1 AS q, 1 AS x, 0 AS z").write.parquet(f"{cell}/entries.parquet")
        spark.sql("SELECT 1L AS sample_seed, 4 AS n_cols, 4 AS n_rows").write.parquet(f"{cell}/dims.parquet")
    assert runs.stored_analyses(spark, run) == ["distances"]
    found = {r["p"]: r for r in runs.load_runs(spark, [run]).collect()}
    assert found[0.1]["b"] is None and found[0.2]["b"] == 5 and found[0.2]["distances"]["d_cont"] == 3
    entries, dims = runs.load_matrices(spark, run)
    assert entries.count() == 2 and set(dims.columns) >= {"run_id", "n", "p", "sample_seed", "n_cols", "n_rows"}
    assert os.path.isdir(run)
