"""Graphs, schedules, crossings and series against known answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rategrid.functions.columns import attach_summary
from rategrid.operators import crossing, graphs, ranks, schedule, survival


def sizes(spark, *ns):
    return spark.createDataFrame([(n,) for n in ns], "n int")


def test_rounds_are_valid(spark):
    for graph, ns in (("complete", (2, 4, 6, 7, 16)), ("cycle", (4, 5, 10))):
        table = sizes(spark, *ns)
        edges, rounds = graphs.edges(table, graph), graphs.rounds(table, graph)
        assert graphs.round_violations(edges, rounds).isEmpty()
        facts = {r["n"]: r for r in graphs.graph_facts(edges, rounds).collect()}
        for n in ns:
            expected = (None if n % 2 else n - 1, n * (n - 1) // 2, n - 1) if graph == "complete" else (None if n % 2 else 2, n, 2)
            assert (facts[n]["chi_prime"], facts[n]["n_edges"], facts[n]["degree_max"]) == expected


def test_defects_are_found(spark):
    table = sizes(spark, 6)
    edges, rounds = graphs.edges(table, "complete"), graphs.rounds(table, "complete")
    doubled = rounds.where("round = 0").withColumn("round", F.lit(9)).unionByName(rounds)
    assert {r["kind"] for r in graphs.round_violations(edges, doubled).collect()} == {"edge_repeated"}
    with pytest.raises(Exception, match="n >= 3"):
        graphs.edges(sizes(spark, 2), "cycle").collect()
    with pytest.raises(ValueError):
        graphs.edges(table, "star")


@pytest.fixture(scope="module")
def runs(spark):
    rows = [(seed, n, 0.3, 2 * n, 3) for seed in range(40) for n in (4, 8)]
    return spark.createDataFrame(rows, "sample_seed bigint, n int, p double, total_layers int, warmup int")


KEYS = ["sample_seed", "n", "p"]


@pytest.mark.parametrize("matching", ["round_robin", "palette", "fresh"])
def test_matchings_cover_each_column_once(runs, matching):
    layers = schedule.layers(runs, KEYS, "warmup")
    gates = schedule.gate_pairs(layers, KEYS, matching=matching)
    ends = gates.select(*KEYS, "phase", "t", F.explode(F.array("u", "v")).alias("q"))
    per_layer = ends.groupBy(*KEYS, "phase", "t").agg(F.countDistinct("q").alias("d"), F.count("*").alias("c"))
    assert per_layer.where("d <> n or c <> n").isEmpty()
    assert per_layer.count() == 40 * (8 + 3 + 16 + 3)
    assert gates.where("u >= v or c < 0 or c >= 11520").isEmpty()


def test_odd_sizes_fail(spark):
    odd = spark.createDataFrame([(1, 5, 0.1, 2)], "sample_seed bigint, n int, p double, total_layers int")
    with pytest.raises(Exception, match="even size"):
        schedule.gate_pairs(schedule.layers(odd, KEYS), KEYS).collect()
    edges = schedule.gate_pairs(schedule.layers(odd, KEYS), KEYS, graph="cycle", gating="random_edge")
    assert edges.count() == 2 and edges.where("not (v - u = 1 or (u = 0 and v = 4))").isEmpty()


def test_measurement_modes(runs):
    layers = schedule.layers(runs, KEYS, "warmup")
    gates = schedule.gate_pairs(layers, KEYS, gating="random_edge")
    uniform = schedule.measurements(layers, KEYS)
    assert uniform.count() == pytest.approx(0.3 * 40 * (8 * 4 + 16 * 8), rel=0.1)
    gated = schedule.measurements(layers, KEYS, "gated", gates)
    touched = gates.where("phase = 'main'").select(*KEYS, "t", F.explode(F.array("u", "v")).alias("q"))
    assert gated.exceptAll(touched).isEmpty() and not gated.isEmpty()
    pair = schedule.measurements(layers, KEYS, "random_pair")
    assert pair.groupBy(*KEYS, "t").count().where("count > 2").isEmpty()
    with pytest.raises(ValueError):
        schedule.measurements(layers, KEYS, "gated")
    with pytest.raises(ValueError):
        schedule.measurements(layers, KEYS, "sometimes")


def test_diagnostics(spark, runs):
    layers = schedule.layers(runs, KEYS, "warmup")
    gates = schedule.gate_pairs(layers, KEYS)
    nothing = schedule.measurements(layers.withColumn("p", F.lit(0.0)), KEYS)
    row = schedule.schedule_diagnostics(runs.withColumn("p", F.lit(0.0)), gates.withColumn("p", F.lit(0.0)), nothing, KEYS).where("n = 8").first()
    assert row["total_layers"] == 16 and row["total_gates"] == 64 and row["avg_gates_per_layer"] == 4.0
    assert row["gate_to_meas_ratio_actual"] == float("inf") == row["gate_to_meas_ratio_expected"]


def test_sweep(spark):
    config = spark.createDataFrame([([8, 12], 0.0, 0.3, 3, 25_001, 42), ([4], 0.1, 0.9, 1, 2, 7)], "sizes array<int>, p_min double, p_max double, n_p int, n_samples int, base_seed int")
    cells = schedule.sweep_cells(config).collect()
    assert len(cells) == 7 and {r["p"] for r in cells if r["n"] == 4} == {0.1}
    samples = schedule.sweep_samples(config)
    assert samples.count() == 6 * 25_001 + 2 and samples.distinct().count() == samples.count()
    assert samples.where("n = 8").agg(F.min("sample_seed"), F.max("sample_seed")).first()[:] == (42, 42 + 25_000)
    assert schedule.steps_to_count(0.0, 0.5, 0.1) == 6
    depth = spark.range(1).select(*[schedule.total_layers("O(log_n)", F.lit(8), F.lit(n)).alias(str(n)) for n in (1, 2, 3, 8, 9)]).first()
    assert depth[:] == (8, 8, 16, 24, 32)


def curve_rows(spark, rows):
    return spark.createDataFrame(rows, "n int, p double, S_mean double")


def estimate(agg, what):
    return what(agg).first()[0]


def test_crossing_known_answers(spark):
    def pair(differences):
        rows = [(8, 0.1 * i, 0.5) for i in range(len(differences))]
        return curve_rows(spark, rows + [(16, 0.1 * i, 0.5 + d) for i, d in enumerate(differences)])

    assert estimate(pair([0.2, -0.2]), crossing.crossing_rate) == pytest.approx(0.05)
    assert estimate(pair([0.2, 0.1, 0.3]), crossing.crossing_rate) is None
    # leading plateau is skipped
    assert estimate(pair([0.0, 0.0, 0.2, -0.2]), crossing.crossing_rate) == pytest.approx(0.25)
    # after a plateau the sign before it counts, and the line runs through the next two points
    assert estimate(pair([0.2, 0.0, -0.1, -0.3]), crossing.crossing_rate) == pytest.approx(0.2 + 0.1 * 0.1 / -0.2 * 1.0)
    assert estimate(pair([0.2, 0.0, 0.1, -0.1]), crossing.crossing_rate) == pytest.approx(0.25)
    single = curve_rows(spark, [(8, 0.1, 0.9), (8, 0.2, 0.3)])
    assert estimate(single, crossing.crossing_rate) is None
    assert estimate(single, crossing.halving_rate) == pytest.approx(0.1 + 0.4 / 0.6 * 0.1)
    assert estimate(single, crossing.critical_rate) == estimate(single, crossing.halving_rate)
    assert estimate(curve_rows(spark, [(8, 0.1, 0.4)]), crossing.halving_rate) == pytest.approx(0.1)
    with pytest.raises(ValueError):
        crossing.critical_rate(single, "guess")


def test_interpolation_clamps(spark):
    df = spark.createDataFrame([(0, float(i), v) for i, v in enumerate([None, 1.0, None, 3.0, None])], "g int, x double, y double")
    got = [r["f"] for r in crossing.interpolate(df, ["g"], "x", "y", "f").orderBy("x").collect()]
    assert got == [1.0, 1.0, 2.0, 3.0, 3.0]


def test_traces(spark):
    df = spark.createDataFrame([(8, 0.4, 1, [1, 1, 0]), (8, 0.4, 2, [1, 0]), (8, 0.5, 3, [1, 1])], "n int, p double, sample_seed bigint, s array<int>")
    padded = df.withColumn("s", survival.pad_trace(F.col("s"), F.lit(4)))
    assert {len(r["s"]) for r in padded.collect()} == {5}
    rows = {r["p"]: r for r in survival.tau_table(survival.explode_traces(padded)).collect()}
    assert rows[0.4]["tau_mean"] == 1.5 and rows[0.4]["n_purified"] == 2 and rows[0.4]["cap"] == 4
    assert rows[0.4]["tau_interp"] == pytest.approx(1.0) and not rows[0.4]["capped"]
    assert rows[0.5]["tau_std"] == 0.0 and rows[0.5]["tau_mean"] == 2.0
    never = survival.explode_traces(df.where("p = 0.5"))
    row = survival.tau_table(never).first()
    assert row["capped"] and row["tau_mean"] is None and row["tau_interp"] is None and row["censor_frac"] == 1.0


def test_ordered_index_of_a_heavy_group(spark):
    df = spark.range(50_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("g"), (F.col("id") * 7919 % 50_000).alias("v"))
    got = ranks.ordered_index(df, ["g"], ["v"], F.floor(F.col("v") / 500), "t")
    wrong = got.join(got.withColumnsRenamed({"v": "w"}).withColumn("t", F.col("t") - 1), ["g", "t"]).where("w <= v")
    assert wrong.isEmpty() and got.groupBy("g").agg(F.max("t") + 1 == F.count("*"), F.min("t")).where("min(t) <> 0").isEmpty()


def test_salted_join_equals_plain_join(spark):
    big = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).cast("int").alias("g"), "id")
    summary = spark.createDataFrame([(g, f"s{g}") for g in range(6)], "g int, s string")
    for how in ("inner", "left"):
        plain = big.join(summary, "g", how)
        for limit in (0, 100):
            got = attach_summary(big, summary, ["g"], how, max_broadcast_bytes=1000 * limit, salts=4).select(*plain.columns)
            assert got.exceptAll(plain).isEmpty() and got.count() == plain.count()
