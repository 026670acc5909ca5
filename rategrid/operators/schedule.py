"""Sweep grids and per-sample schedules as tables: layers, gate pairs, labels, measurements.

Everything is computed from the sample's own columns; no table is joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rategrid.functions.draws import below, draw_bits, uniform
from rategrid.functions.numeric import INFINITY, ceil_log2
from rategrid.operators.graphs import check_graph, pair_at, round_count

DEPTH_MODES = ("O(n)", "O(log_n)", "until_purified")
MATCHING_MODES = ("round_robin", "palette", "fresh")
MEASUREMENT_MODES = ("uniform", "gated", "random_pair")
GATING_MODES = ("matching", "random_edge")
BLOCK = 10_000


def _choice(name: str, value: str, known: Sequence[str]) -> str:
    if value not in known:
        raise ValueError(f"{name} must be one of {tuple(known)}; got {value!r}")
    return value


# ------------------------------------------------------------------ grids


def rate_grid(p_min: Column, p_max: Column, n_p: Column) -> Column:
    """``n_p`` evenly spaced rates as an array; only ``p_min`` if there is one."""
    step = (p_max - p_min) / F.greatest(n_p - 1, F.lit(1))
    last = n_p - 1
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda j: F.when((j == last) & (last > 0), p_max).otherwise(p_min + j * step),
    )


def steps_to_count(p_min: float, p_max: float, step: float) -> int:
    """Number of grid points for a wanted step; the grid itself stays evenly spaced."""
    return int(round((p_max - p_min) / step)) + 1


def sweep_cells(configs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cells of each configuration ``(sizes, p_min, p_max, n_p, n_samples, base_seed)``."""
    sized = configs.select("*", F.explode("sizes").alias("n"))
    rates = rate_grid(F.col("p_min"), F.col("p_max"), F.col("n_p"))
    return sized.select(*by, "n", F.explode(rates).alias("p"), "n_samples", "base_seed")


def sweep_samples(configs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per sample.  Cells are cut into blocks first, so a large cell is spread."""
    cells = sweep_cells(configs, by)
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("n_samples").cast("bigint") - 1, F.lit(BLOCK).cast("bigint"))
    blocks = cells.where("n_samples > 0").select("*", F.explode(starts).alias("_from"))
    spread = blocks.repartition(*by, "n", "p", "_from")
    last = F.least(F.col("_from") + BLOCK, F.col("n_samples")) - 1
    return spread.select(*by, "n", "p", "base_seed", F.explode(F.sequence("_from", last)).alias("_offset")).select(
        *by, "n", "p", (F.col("base_seed") + F.col("_offset")).alias("sample_seed")
    )


def total_layers(mode: str, factor: Column, n: Column) -> Column:
    """Layer count of a cell, at least 1; for early-stopped runs this is the cap."""
    _choice("depth_mode", mode, DEPTH_MODES)
    scale = F.greatest(ceil_log2(n), F.lit(1)) if mode == "O(log_n)" else n
    return F.greatest(factor * scale, F.lit(1)).cast("int")


def warmup_layers(scale: Column, n: Column) -> Column:
    """Warm-up depth proportional to the size, rounded half to even."""
    return F.bround(scale * n, 0).cast("int")


# ------------------------------------------------------------------ layers


def layers(samples: DataFrame, keys: Sequence[str], warmup: str | None = None, depth: str = "total_layers") -> DataFrame:
    """Warm-up and main layers of each sample; each phase starts at t = 0.

    The samples are spread by key before they fan out into layers and gates, so later
    groupings by sample find their rows in place.
    """
    first = F.lit(0) if warmup is None else -F.col(warmup)
    spark = samples.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a fixed number: adaptive coalescing looks at the small rows before they fan out
    spread = samples.repartition(tasks, *keys).where(F.col(depth) > 0)
    steps = spread.select(*keys, first.alias("_first"), F.explode(F.sequence(first, F.col(depth) - 1)).alias("_t"))
    early = F.col("_t") < 0
    return steps.select(
        *keys,
        F.when(early, "warmup").otherwise("main").alias("phase"),
        F.when(early, F.col("_t") - F.col("_first")).otherwise(F.col("_t")).alias("t"),
    )


def _even(n: Column) -> Column:
    """The size, or an error for odd sizes, which have no perfect matching."""
    message = F.concat(F.lit("matchings need an even size; got n="), n.cast("string"))
    return F.when(n % 2 == 0, n).otherwise(F.raise_error(message).cast("int"))


def _shuffled(n: Column, tag: str, *keys: Column, engine: str) -> Column:
    """The vertices in order of their draws: a random permutation of each layer."""
    drawn = F.transform(
        F.sequence(F.lit(0), n - 1), lambda q: F.struct(draw_bits(tag, *keys, q, engine=engine).alias("d"), q.alias("q"))
    )
    return F.array_sort(drawn)


def gate_pairs(
    layer_rows: DataFrame,
    keys: Sequence[str],
    graph: str = "complete",
    gating: str = "matching",
    matching: str = "round_robin",
    n_labels: int = 11520,
    seed: str = "sample_seed",
    engine: str = "xxhash64",
) -> DataFrame:
    """Gates ``(keys, phase, t, i, u, v, c)`` of every layer, ``c`` in [0, n_labels)."""
    check_graph(graph)
    _choice("gating_mode", gating, GATING_MODES)
    _choice("matching_mode", matching, MATCHING_MODES)
    n, ident = F.col("n"), (F.col(seed), F.col("phase"), F.col("t"))
    if gating == "random_edge":
        if graph == "cycle":
            a = below(n, "edge", *ident, engine=engine)
            b = F.pmod(a + 1, n)
        else:
            a = below(n, "edge_a", *ident, engine=engine)
            other = below(n - 1, "edge_b", *ident, engine=engine)
            b = F.when(other >= a, other + 1).otherwise(other)
        ends = layer_rows.select(*keys, "phase", "t", F.lit(0).alias("i"), a.alias("_a"), b.alias("_b"))
        pairs = ends.select(
            *keys, "phase", "t", "i", F.least("_a", "_b").cast("int").alias("u"), F.greatest("_a", "_b").cast("int").alias("v")
        )
    elif matching == "fresh" and graph == "complete":
        # neighbours of the permutation form the pairs
        order = layer_rows.withColumn("n", _even(n)).withColumn("_order", _shuffled(n, "fresh", *ident, engine=engine))
        slots = order.select(*keys, "phase", "t", "_order", F.explode(F.sequence(F.lit(0), (n / 2).cast("int") - 1)).alias("i"))
        a, b = F.col("_order")[2 * F.col("i")]["q"], F.col("_order")[2 * F.col("i") + 1]["q"]
        pairs = slots.select(
            *keys, "phase", "t", "i", F.least(a, b).cast("int").alias("u"), F.greatest(a, b).cast("int").alias("v")
        )
    else:
        chi = round_count(graph, n)
        picked = F.pmod(F.col("t"), chi) if matching == "round_robin" else below(chi, "round", *ident, engine=engine)
        slots = layer_rows.withColumn("n", _even(n)).select(
            *keys, "phase", "t", picked.alias("_r"), F.explode(F.sequence(F.lit(0), (n / 2).cast("int") - 1)).alias("i")
        )
        u, v = pair_at(graph, n, F.col("_r"), F.col("i"))
        pairs = slots.select(*keys, "phase", "t", "i", u.alias("u"), v.alias("v"))
    label = below(F.lit(n_labels), "label", *ident, F.col("u"), F.col("v"), engine=engine)
    return pairs.withColumn("c", label)


def measurements(
    layer_rows: DataFrame,
    keys: Sequence[str],
    mode: str = "uniform",
    gates: DataFrame | None = None,
    seed: str = "sample_seed",
    engine: str = "xxhash64",
) -> DataFrame:
    """Measured columns ``(keys, t, q)`` of the main layers, each at most once per layer."""
    _choice("measurement_mode", mode, MEASUREMENT_MODES)
    rate = F.col("p").cast("double")
    inside = F.when((rate >= 0) & (rate <= 1), F.col("p"))
    checked = F.when(F.col("p").isNull(), F.col("p")).otherwise(
        F.coalesce(inside, F.raise_error(F.concat(F.lit("measurement rate outside [0, 1]: "), F.col("p").cast("string"))))
    )
    main = layer_rows.where("phase = 'main'").withColumn("p", checked)
    ident = (F.col(seed), F.col("t"))
    n = F.col("n")
    if mode == "uniform":
        candidates = main.select(*keys, "t", F.explode(F.sequence(F.lit(0), n - 1)).alias("q"))
    elif mode == "gated":
        if gates is None:
            raise ValueError("gated measurements need the gate table")
        # both ends of each pair; the pairs of one layer share no column
        candidates = gates.where("phase = 'main'").select(*keys, "t", F.explode(F.array("u", "v")).alias("q"))
    else:
        first = below(n, "pair_a", *ident, engine=engine)
        other = below(n - 1, "pair_b", *ident, engine=engine)
        second = F.when(other >= first, other + 1).otherwise(other)
        candidates = main.where("n >= 2").select(*keys, "t", F.explode(F.array(first, second)).alias("q"))
    chance = uniform("measure", *ident, F.col("q"), engine=engine)
    return candidates.where(chance < F.col("p"))


# ------------------------------------------------------------------ diagnostics


def schedule_diagnostics(
    samples: DataFrame, gates: DataFrame, measured: DataFrame, keys: Sequence[str], measured_by: Sequence[str] | None = None
) -> DataFrame:
    """Per sample: layers, gates, measurements and their actual and expected ratio.

    Only the main phase counts; warm-up layers and gates do not.  Rows of ``samples`` with equal keys and depth are
    copies of one sample: each is kept and has the gates of one.  Measurements are counted by ``measured_by`` (the
    keys, if not given) over all rows that share it.
    """
    keys, pooled = list(keys), list(measured_by or keys)
    # counted first, so no join multiplies the gates of a repeated sample
    rows = samples.groupBy(*keys, "total_layers").agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    gate_counts = gates.where("phase = 'main'").groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    measure_counts = measured.groupBy(*pooled).agg(F.count(F.lit(1)).alias("_m"))
    each = (F.col("_all") / F.col("_copies")).cast("bigint")
    joined = rows.join(gate_counts, keys, "left").join(measure_counts, pooled, "left").withColumn("_g", each)
    joined = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    g, m = (F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("_g", "_m"))
    inf = F.lit(INFINITY)
    return joined.select(
        *keys,
        F.col("total_layers").cast("bigint").alias("total_layers"),
        g.alias("total_gates"),
        (g / F.greatest(F.col("total_layers"), F.lit(1))).alias("avg_gates_per_layer"),
        m.alias("total_measurements"),
        F.when(F.col("p") > 0, F.lit(1.0) / (F.lit(2.0) * F.col("p"))).otherwise(inf).alias("gate_to_meas_ratio_expected"),
        F.when(m > 0, g / m).otherwise(inf).alias("gate_to_meas_ratio_actual"),
    )
