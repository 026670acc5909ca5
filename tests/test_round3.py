"""Results and plans that must not depend on how large the tables are."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rategrid.functions.words import rowwise
from rategrid.operators import gf2, graphs, schedule
from rategrid.operators import incidence as incidence_ops
from rategrid.sources import series
from rategrid.streaming import early_stop, ingest

KEYS = ["sample_seed", "n", "p"]


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_layers_are_nested_without_a_join(spark):
    gates = spark.createDataFrame(
        [(1, 4, None, 0, 1, 0, 3, 7), (1, 4, None, 0, 0, 1, 2, 5), (2, 4, 0.5, 3, 0, 0, 1, 9)],
        "sample_seed bigint, n int, p double, t int, i int, u int, v int, c int",
    )
    measured = spark.createDataFrame(
        [(1, 4, None, 0, 3), (1, 4, None, 0, 0), (2, 4, 0.5, 1, 2)], "sample_seed bigint, n int, p double, t int, q int"
    )
    nested = series.nest_layers(gates, measured, KEYS)
    assert "Join" not in optimized(nested)  # a side of a join may be broadcast whole
    rows = {(r["sample_seed"], r["t"]): ([tuple(g) for g in r["gates"]], r["meas"]) for r in nested.collect()}
    assert rows == {(1, 0): ([(1, 2, 5), (0, 3, 7)], [0, 3]), (2, 3): ([(0, 1, 9)], []), (2, 1): ([], [2])}
    assert series.gates_of(nested, KEYS).count() == 3 and series.measurements_of(nested, KEYS).count() == 3


def test_first_zero_table_over_batches(spark, tmp_path):
    folder = str(tmp_path / "arriving")
    schema = "n int, p double, sample_seed bigint, t bigint, s int"
    batches = [
        [(4, 0.1, 1, 0, 1), (4, 0.1, 2, 0, 1), (4, 0.1, 2, 1, 0), (4, 0.1, 2, 2, 0), (4, 0.1, 3, 0, 1), (4, 0.1, 4, 2, 1)],
        [(4, 0.1, 1, 1, 1), (4, 0.1, 1, 2, 0), (4, 0.1, 2, 3, 0), (4, 0.1, 3, 1, 1), (4, 0.1, 3, 2, 1), (4, 0.1, 4, 3, 0)],
        [(4, 0.1, 3, 3, 0)],  # behind the cap: stays censored
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = ingest.file_stream(spark, folder, spark.read.parquet(folder).schema, per_trigger=1)
    table = early_stop.first_zero_table(stream, cap=2)
    assert "FlatMapGroupsInPandasWithState" not in table._jdf.queryExecution().logical().toString()
    found = ingest.drain(table, "zeros", "update", KEYS)
    assert {(r["sample_seed"], r["tau"], r["censored"]) for r in found.collect()} == {
        (1, 2, False), (2, 1, False), (3, None, True), (4, None, True)
    }
    assert found.count() == 4


def test_diagnostics_of_repeated_samples(spark):
    rows = [(1, 4, 0.5, 4), (1, 4, 0.5, 4), (1, 6, 0.25, 6), (2, 4, 0.5, 4)]
    runs = spark.createDataFrame(rows, "sample_seed bigint, n int, p double, total_layers int")
    layers = schedule.layers(runs, KEYS)
    gates, measured = schedule.gate_pairs(layers, KEYS), schedule.measurements(layers, KEYS)
    found = schedule.schedule_diagnostics(runs, gates, measured, KEYS, measured_by=["sample_seed"]).collect()
    counts = {r["sample_seed"]: r["count"] for r in measured.groupBy("sample_seed").count().collect()}
    assert sorted((r["sample_seed"], r["n"], r["total_gates"]) for r in found) == [(1, 4, 8), (1, 4, 8), (1, 6, 18), (2, 4, 8)]
    assert all(r["total_measurements"] == counts.get(r["sample_seed"], 0) for r in found)


def test_partial_bases_are_handed_on_by_memory():
    read = 0

    def batches():
        nonlocal read
        for first in range(0, 300_000, 10_000):
            read += 1
            yield pd.DataFrame({"k": range(first, first + 10_000), "words": [[5, 0]] * 10_000})

    frames = gf2._partial_bases(["k"])(batches())
    first = next(frames)
    assert len(first) <= gf2.FRAME_ROWS and read < 15  # 300,000 small matrices are not held at once
    rest = list(frames)
    assert max(map(len, rest)) <= gf2.FRAME_ROWS
    assert pd.concat([first, *rest])["k"].tolist() == list(range(300_000))


def test_rowwise_results(spark):
    calls = rowwise(T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))(lambda x, y: None if y < 0 else [v + y for v in x])
    df = spark.range(1000).selectExpr("id", "array(cast(id as int), 1) as x", "cast(id % 3 - 1 as int) as y").coalesce(1)
    for r in df.select("id", calls("x", "y").alias("z")).collect():
        y = r["id"] % 3 - 1
        assert r["z"] == (None if y < 0 else [r["id"] + y, 1 + y])
    assert df.where("id < 0").select(calls("x", "y").alias("z")).collect() == []


def test_pairs_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(graphs, "PAIRS_PER_TASK", 1000)
    sizes = spark.range(60, 70).selectExpr("cast(id as int) as n").coalesce(1)
    edges, rounds = graphs.edges(sizes, "complete"), graphs.rounds(sizes, "complete")
    for table in (edges, rounds):  # about 20,000 and 10,000 pairs
        made = table.groupBy(F.spark_partition_id()).count().collect()
        assert len(made) > 8 and max(r["count"] for r in made) < 4000
    assert graphs.round_violations(edges, rounds).isEmpty()
    broken = rounds.where("not (n = 60 and round = 1 and i = 1)").unionByName(
        spark.createDataFrame([(62, 0, 40, 7, 70), (62, 0, 41, 0, 61)], "n int, round int, i int, u int, v int")
    )
    plan = graphs.round_violations(edges, broken)
    assert "Join" not in optimized(plan)
    assert {(r["n"], r["kind"]): r["defects"] for r in plan.collect()} == {
        (60, "vertex_missing"): 1, (60, "edge_unused"): 1,
        (62, "vertex_not_once"): 3, (62, "vertex_missing"): 1, (62, "edge_repeated"): 1, (62, "edge_foreign"): 1,
    }


def test_clashes_of_many_rows_and_null_rows(spark):
    entries = [(1, r, q, (r + q) % 2, 1 - (r + q) % 2) for r in range(150) for q in range(3) if (r * q) % 5 != 1] + [(1, None, 0, 1, 0)]
    incidence = spark.createDataFrame(entries, "sample_seed bigint, r int, q int, x int, z int")
    dims = spark.createDataFrame([(1, 3, 150), (2, 3, 150)], "sample_seed bigint, n_cols int, n_rows int")
    listed = {10: [(0, 1, 0), (1, 1, 0), (2, 0, 1)], 11: [(0, 0, 1)], 12: [(1, 1, 1), (2, 1, 0)]}
    rows = [(3, v, *e) for v, es in listed.items() for e in es]
    vectors = spark.createDataFrame(rows, "n_cols int, v int, q int, vx int, vz int")
    want = {}
    for v, es in listed.items():
        odd: dict = {}
        for _, r, q, x, z in entries:
            for vq, vx, vz in es:
                if vq == q:
                    odd[r] = odd.get(r, 0) ^ (x * vz + z * vx) % 2
        want |= {(1, v): sum(odd.values()), (2, v): 0}
    found = incidence_ops.commutation(incidence, dims, vectors, ["sample_seed"])
    assert {(r["sample_seed"], r["v"]): r["clashes"] for r in found.collect()} == want
    plan = optimized(incidence_ops.clashing(incidence, dims, vectors, ["sample_seed"]))
    groups = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert groups and not any("v#" in g and ", r#" in g.split("]")[0] for g in groups)
