"""Sources, sinks, registry and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rategrid.catalog import views as V
from rategrid.catalog.base import Tables, query
from rategrid.catalog.schedules import KEYS, RUNS_SQL, _hash, _layers
from rategrid.functions import naming
from rategrid.operators import schedule, survival
from rategrid.plans import registry as reg
from rategrid.sources import folders, manifest, records, runs, series
from rategrid.streaming import early_stop, ingest, running

# ---------------------------------------------------------------- manifests and records

MANIFEST_SQL = """manifests AS (SELECT 'run-' || o_orderkey AS run_id, CASE o_custkey % 6
  WHEN 0 THEN '{"config": {"picture": "alpha"}, "picture": "delta"}' WHEN 1 THEN '{"circuit_config": {"picture": "beta"}}'
  WHEN 2 THEN '{"config": {"picture": 5}, "circuit": {"picture": "gamma"}}' WHEN 3 THEN '{"config": "none", "picture": "delta"}'
  WHEN 4 THEN '{"config": {"n": 8}}' ELSE '{"config": {"picture": "al' END AS manifest FROM orders)"""


def _manifests(t: Tables) -> DataFrame:
    texts = [
        '{"config": {"picture": "alpha"}, "picture": "delta"}',
        '{"circuit_config": {"picture": "beta"}}',
        '{"config": {"picture": 5}, "circuit": {"picture": "gamma"}}',
        '{"config": "none", "picture": "delta"}',
        '{"config": {"n": 8}}',
        '{"config": {"picture": "al',
    ]
    choice = F.array(*[F.lit(x) for x in texts])[(F.col("o_custkey") % 6).cast("int")]
    return t.orders.select(F.concat(F.lit("run-"), F.col("o_orderkey")).alias("run_id"), choice.alias("manifest"))


@query(
    "manifest_picture",
    f"""WITH {MANIFEST_SQL} SELECT run_id, CASE WHEN NOT json_valid(manifest) THEN NULL
          WHEN json_type(manifest, '$.config.picture') = 'VARCHAR' THEN manifest ->> '$.config.picture'
          WHEN json_type(manifest, '$.circuit_config.picture') = 'VARCHAR' THEN manifest ->> '$.circuit_config.picture'
          WHEN json_type(manifest, '$.circuit.picture') = 'VARCHAR' THEN manifest ->> '$.circuit.picture'
          WHEN json_type(manifest, '$.picture') = 'VARCHAR' THEN manifest ->> '$.picture' END AS picture FROM manifests""",
)
def manifest_picture(t: Tables) -> DataFrame:
    return _manifests(t).select("run_id", manifest.picture(F.col("manifest")).alias("picture"))


@query(
    "benchmark_records",
    """SELECT event_type AS model, count(*) AS records, avg(value) AS t_mean, sum(CAST(props ->> '$.k' AS BIGINT)) AS sum_k
       FROM events WHERE event_type <> 'error' AND value > 0 GROUP BY 1""",
    ("t_mean",),
)
def benchmark_records(t: Tables) -> DataFrame:
    raw = t.events.select(
        F.col("event_type").alias("model"),
        F.col("value").alias("time"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.when(F.col("event_type") == "error", "failed").alias("error"),
    )
    clean = records.clean_records(raw)
    return clean.groupBy("model").agg(
        F.count(F.lit(1)).alias("records"), F.avg("time").alias("t_mean"), F.sum("k").alias("sum_k")
    )


@query(
    "config_names",
    """SELECT CASE o_custkey % 3 WHEN 0 THEN 'NN' WHEN 1 THEN 'ATA' ELSE 'tree' END || '-round_robin-uniform-' ||
         CASE o_orderkey % 3 WHEN 0 THEN 'On' WHEN 1 THEN 'Ologn' ELSE 'depth' END AS slug,
       printf('n=%04d/p=%.4f', CAST(o_custkey % 7 + 1 AS INTEGER), month(o_orderdate) / 100) AS cell,
       substr(sha1(CAST(o_custkey AS VARCHAR)), 1, 7) AS digest, count(*) AS rows FROM orders GROUP BY 1, 2, 3""",
)
def config_names(t: Tables) -> DataFrame:
    graph = F.when(F.col("o_custkey") % 3 == 0, "cycle").when(F.col("o_custkey") % 3 == 1, "complete").otherwise("tree")
    depth = F.when(F.col("o_orderkey") % 3 == 0, "O(n)").when(F.col("o_orderkey") % 3 == 1, "O(log_n)").otherwise("until_purified")
    return t.orders.groupBy(
        naming.config_slug(graph, F.lit("round_robin"), F.lit("uniform"), depth).alias("slug"),
        naming.cell_path(F.col("o_custkey") % 7 + 1, F.month("o_orderdate") / 100).alias("cell"),
        naming.config_digest(F.col("o_custkey").cast("string")).alias("digest"),
    ).agg(F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------- cells and sinks


@query(
    "cell_discovery",
    f"WITH {V.SAMPLES_SQL} SELECT DISTINCT n, p FROM samples WHERE n IN (1, 3, 5) AND (abs(p - 0.02) < 1e-9 OR abs(p - 0.07) < 1e-9)",
)
def cell_discovery(t: Tables) -> DataFrame:
    return runs.cells(V.samples(t), sizes=[1, 3, 5], rates=[0.02, 0.07])


@query(
    "cell_index",
    """SELECT l_linenumber AS n, l_discount AS p, count(*) AS n_samples, max(CASE WHEN l_suppkey = 3 THEN 1 ELSE 0 END) = 1 AS has_tableau,
       max(CASE WHEN l_partkey % 997 = 1 THEN 1 ELSE 0 END) = 1 AS has_realization FROM lineitem GROUP BY 1, 2""",
)
def cell_index(t: Tables) -> DataFrame:
    cells = t.lineitem.select(F.col("l_linenumber").alias("n"), F.col("l_discount").alias("p"), "l_suppkey", "l_partkey")
    return runs.cell_index(cells, cells.where("l_suppkey = 3"), cells.where("l_partkey % 997 = 1"))


@query(
    "written_samples",
    f"WITH {V.SAMPLES_SQL} SELECT run_id, n, p, count(*) AS rows, sum(k) AS sum_k, sum(sample_seed) AS seeds FROM samples GROUP BY 1, 2, 3",
)
def written_samples(t: Tables) -> DataFrame:
    """Write the samples by cell, read them back and summarise."""
    target = ingest.scratch(t.spark, "samples")
    runs.write_cells(V.samples(t), target)
    stored = runs.read_cells(t.spark, target)
    return stored.groupBy("run_id", "n", "p").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("obs.k").alias("sum_k"), F.sum("sample_seed").alias("seeds")
    )


# ---------------------------------------------------------------- run folders: write the layout, read it back


def _run_folders(t: Tables, tables: dict) -> list[str]:
    """The tables as run folders by artefact; the folders of the first."""
    root = ingest.scratch(t.spark, "runs")
    return [folders.write_run_folders(df, root, artefact) for artefact, df in tables.items()][0]


def _flat_samples(t: Tables) -> DataFrame:
    """Samples with literal dotted columns, as run folders store them."""
    return V.samples(t).select("run_id", "n", "p", "sample_seed", F.col("obs.k").alias("obs.k"), F.col("obs.tmi").alias("obs.tmi"))


def _sample_distances(t: Tables) -> DataFrame:
    """One row per sample that has distances, with the sample's cell."""
    # both sides are placed by sample at once: the distinct keys and the join need no other shuffle
    keys, rows = V.samples(t).select(*runs.SAMPLE_KEY), t.lineitem.count()
    placed = [folders.spread(df, rows, "sample_seed") for df in (keys, V.distances(t))]
    return placed[0].distinct().join(placed[1], "sample_seed").select(*runs.SAMPLE_KEY, "distances.*")


@query(
    "run_folder_samples",
    f"""WITH {V.SAMPLES_SQL} SELECT run_id, n, p, count(*) AS rows, sum(k) AS sum_k, avg(tmi) AS mean_tmi, sum(sample_seed) AS seeds
        FROM samples GROUP BY 1, 2, 3""",
    ("mean_tmi",),
)
def run_folder_samples(t: Tables) -> DataFrame:
    """All runs' samples from one scan; run and cell come from the paths."""
    stored = folders.scan_samples(t.spark, _run_folders(t, {"samples": _flat_samples(t)}))
    return stored.groupBy("run_id", "n", "p").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("obs.k").alias("sum_k"), F.avg("obs.tmi").alias("mean_tmi"), F.sum("sample_seed").alias("seeds")
    )


@query(
    "run_folder_analyses",
    f"""WITH {V.SAMPLES_SQL}, {V.DISTANCES_SQL} SELECT run_id, n, p, count(*) AS rows, count(d_cont) AS with_distances,
          sum(d_cont) AS sum_d_cont, sum(d_min * k) AS sum_d_min_k FROM samples LEFT JOIN distances USING (sample_seed) GROUP BY 1, 2, 3""",
)
def run_folder_analyses(t: Tables) -> DataFrame:
    """Samples with an analysis that only some of them have, both from run folders."""
    paths = _run_folders(t, {"samples": _flat_samples(t), "analysis/distances": _sample_distances(t)})
    tables = {"distances": folders.scan_analysis(t.spark, paths, "distances")}
    whole = folders.attach_scanned(folders.scan_samples(t.spark, paths), tables)
    return whole.groupBy("run_id", "n", "p").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("distances.d_cont").alias("with_distances"),
        F.sum("distances.d_cont").alias("sum_d_cont"),
        F.sum(F.col("distances.d_min") * F.col("obs.k")).alias("sum_d_min_k"),
    )


@query(
    "run_folder_traces",
    f"""WITH {V.BITS_SQL} SELECT 'bits' AS run_id, n, p, CAST(t AS INTEGER) AS t, count(*) AS samples, sum(s) AS alive
        FROM bit_rows JOIN bit_traces USING (n, p, sample_seed) WHERE t <= last_t GROUP BY 2, 3, 4""",
)
def run_folder_traces(t: Tables) -> DataFrame:
    """Traces stored as arrays, read back and exploded to steps."""
    paths = _run_folders(t, {"timeseries": V.bit_traces(t).select(F.lit("bits").alias("run_id"), "*")})
    steps = survival.explode_traces(folders.scan_traces(t.spark, paths).drop("_source"))
    return steps.groupBy("run_id", "n", "p", F.col("t").cast("int").alias("t")).agg(
        F.count(F.lit(1)).alias("samples"), F.sum("s").cast("bigint").alias("alive")
    )


@query(
    "run_folder_matrices",
    f"""WITH {V.MATRIX_SQL}, per AS (SELECT sample_seed, count(*) AS n, sum(x) AS xs, sum(z) AS zs, sum(r * 37 + q) AS places FROM entries GROUP BY 1)
        SELECT 'run' || sample_seed % 3 AS run_id, n_cols AS n, CAST(sample_seed % 4 AS DOUBLE) / 10 AS p, count(*) AS matrices, sum(n_rows) AS n_rows,
          coalesce(sum(per.n), 0) AS entries, coalesce(sum(xs), 0) AS xs, coalesce(sum(zs), 0) AS zs, coalesce(sum(places), 0) AS places
        FROM dims LEFT JOIN per USING (sample_seed) GROUP BY 1, 2, 3""",
)
def run_folder_matrices(t: Tables) -> DataFrame:
    """Bit matrices of three runs: entries and dims, one scan each."""
    cell = [
        F.concat(F.lit("run"), F.col("sample_seed") % 3).alias("run_id"),
        F.lit(V.N_COLS).alias("n"),
        ((F.col("sample_seed") % 4).cast("double") / 10).alias("p"),
        "*",
    ]
    paths = _run_folders(t, {"dims": V.matrix_dims(t).select(*cell), "entries": V.matrix_entries(t).select(*cell)})
    entries, dims = folders.scan_matrices(t.spark, paths)
    at = ["run_id", "n", "p"]
    shape = dims.groupBy(*at).agg(F.count(F.lit(1)).alias("matrices"), F.sum("n_rows").alias("n_rows"))
    filled = entries.groupBy(*at).agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum("x").cast("bigint").alias("xs"),
        F.sum("z").cast("bigint").alias("zs"),
        F.sum(F.col("r") * 37 + F.col("q")).alias("places"),
    )
    return shape.join(filled, at, "left").na.fill(0, ["entries", "xs", "zs", "places"])


@query(
    "realization_layers",
    f"""WITH {RUNS_SQL}, gates AS (SELECT n, count(*) AS gates, sum(c) AS sum_c FROM (
          SELECT n, {_hash('label', 'sample_seed', 'phase', 't', 'u', 'v')} % 11520 AS c FROM (
            SELECT sample_seed, n, phase, t, least(a, (a + 1) % n) AS u, greatest(a, (a + 1) % n) AS v FROM (
              SELECT *, 2 * i + t % 2 AS a FROM layers, (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS i) WHERE i < n // 2 AND phase = 'main'))) GROUP BY n),
        meas AS (SELECT n, count(*) AS measured, sum(q) AS sum_q FROM (SELECT *, unnest(range(0, n)) AS q FROM layers WHERE phase = 'main')
          WHERE {_hash('measure', 'sample_seed', 't', 'q')} / 4503599627370496.0 < p GROUP BY n)
        SELECT * FROM gates JOIN meas USING (n)""",
)
def realization_layers(t: Tables) -> DataFrame:
    """Nest a schedule into one row per layer and read both tables out of it again."""
    rows = _layers(t).where("phase = 'main'")
    gates = schedule.gate_pairs(rows, KEYS, graph="cycle", engine="md5")
    nested = series.nest_layers(gates, schedule.measurements(rows, KEYS, engine="md5"), KEYS)
    per_gate = series.gates_of(nested, KEYS).groupBy("n").agg(F.count(F.lit(1)).alias("gates"), F.sum("c").alias("sum_c"))
    per_meas = series.measurements_of(nested, KEYS).groupBy("n").agg(F.count(F.lit(1)).alias("measured"), F.sum("q").alias("sum_q"))
    return per_gate.join(per_meas, "n")


# ---------------------------------------------------------------- registry

REG_SQL = """registry AS (SELECT o_orderpriority AS run_id, CAST(o_custkey % 7 + 1 AS INTEGER) AS n, month(o_orderdate) / 100 AS p,
    ['distances', 'weight_stats', 'entropy_profile'][o_custkey % 3 + 1] AS analysis,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '#' || o_orderkey AS computed_utc, o_orderkey AS n_samples FROM orders WHERE o_orderkey % 11 = 0),
wanted AS (SELECT DISTINCT o_orderpriority AS run_id, CAST(o_custkey % 7 + 1 AS INTEGER) AS n, month(o_orderdate) / 100 AS p FROM orders),
owned AS (SELECT DISTINCT o_orderpriority AS run_id, CAST(o_custkey % 7 + 1 AS INTEGER) AS n, month(o_orderdate) / 100 AS p FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 3 = 0),
plan AS (SELECT w.*, a.analysis, CASE WHEN o.n IS NULL THEN 'skipped' WHEN r.n IS NOT NULL AND a.analysis <> 'distances' THEN 'existing' ELSE 'compute' END AS action
  FROM wanted w CROSS JOIN (VALUES ('distances'), ('weight_stats'), ('entropy_profile')) a(analysis) LEFT JOIN owned o USING (run_id, n, p)
  LEFT JOIN (SELECT DISTINCT run_id, n, p, analysis FROM registry) r ON r.run_id = w.run_id AND r.n = w.n AND r.p = w.p AND r.analysis = a.analysis)"""
NAMES = ("distances", "weight_stats", "entropy_profile")


def _cells(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderpriority").alias("run_id"),
        (F.col("o_custkey") % 7 + 1).cast("int").alias("n"),
        (F.month("o_orderdate") / 100).alias("p"),
        "*",
    )


def _registry(t: Tables) -> DataFrame:
    name = F.array(*[F.lit(a) for a in NAMES])[(F.col("o_custkey") % 3).cast("int")]
    stamp = F.concat_ws("#", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("o_orderkey").cast("string"))
    done = _cells(t).where("o_orderkey % 11 = 0")
    return done.select("run_id", "n", "p", name.alias("analysis"), stamp.alias("computed_utc"), F.col("o_orderkey").alias("n_samples"))


def _plan(t: Tables) -> DataFrame:
    cells = _cells(t)
    owned = cells.where("o_orderstatus <> 'P' and o_orderkey % 3 = 0")
    return reg.work_plan(runs.cells(cells, keys=reg.CELL), NAMES, _registry(t), ["distances"], owned)


@query(
    "registry_latest",
    f"""WITH {REG_SQL} SELECT run_id, n, p, analysis, max(computed_utc) AS computed_utc, arg_max(n_samples, computed_utc) AS n_samples
        FROM registry GROUP BY 1, 2, 3, 4""",
)
def registry_latest(t: Tables) -> DataFrame:
    return reg.latest_entries(_registry(t))


@query("work_plan", f"WITH {REG_SQL} SELECT run_id, n, p, analysis, action FROM plan")
def work_plan(t: Tables) -> DataFrame:
    return _plan(t)


@query("missing_work", f"WITH {REG_SQL} SELECT run_id, n, p, analysis FROM plan WHERE action = 'compute'")
def missing_work(t: Tables) -> DataFrame:
    return reg.missing_work(_plan(t))


@query(
    "status_counts",
    f"""WITH {REG_SQL} SELECT analysis, count(*) FILTER (action = 'compute') AS computed, count(*) FILTER (action = 'existing') AS existing,
        count(*) FILTER (action = 'skipped') AS skipped, CAST(0 AS BIGINT) AS error FROM plan GROUP BY 1""",
)
def status_counts(t: Tables) -> DataFrame:
    status = F.when(F.col("action") == "compute", "computed").otherwise(F.col("action"))
    return reg.status_counts(_plan(t).withColumn("status", status))


@query(
    "analysis_summary",
    f"""WITH {REG_SQL}, done AS (SELECT w.run_id, printf('n=%04d/p=%.4f', w.n, w.p) AS cell,
          '"' || printf('n=%04d/p=%.4f', w.n, w.p) || '":[' || coalesce(string_agg(DISTINCT '"' || analysis || '"', ',' ORDER BY '"' || analysis || '"'), '') || ']' AS entry
          FROM wanted w LEFT JOIN registry r ON r.run_id = w.run_id AND r.n = w.n AND r.p = w.p GROUP BY w.run_id, w.n, w.p)
        SELECT run_id, '{{"per_cell":{{' || string_agg(entry, ',' ORDER BY cell) || '}},"run_level":["aggregates"]}}' AS analysis_summary FROM done GROUP BY 1""",
)
def analysis_summary(t: Tables) -> DataFrame:
    cells = runs.cells(_cells(t), keys=reg.CELL)
    run_level = cells.select("run_id").distinct().withColumn("analysis", F.lit("aggregates"))
    return manifest.analysis_summary(cells, _registry(t), run_level)


# ---------------------------------------------------------------- streaming


def _event_stream(t: Tables) -> DataFrame:
    return ingest.file_stream(t.spark, t.folder, t.events.schema, "events.parquet")


@query(
    "stream_running_cells",
    """SELECT CAST(user_id % 4 AS INTEGER) + 1 AS n, event_type AS kind, count(value) AS count, avg(value) AS S_mean, stddev_samp(value) AS S_std,
       stddev_samp(value) / sqrt(count(value)) AS S_sem FROM events GROUP BY 1, 2""",
    ("S_mean", "S_std", "S_sem"),
)
def stream_running_cells(t: Tables) -> DataFrame:
    cells = _event_stream(t).withColumn("n", (F.col("user_id") % 4).cast("int") + 1).withColumn("kind", F.col("event_type"))
    sums = running.running_cells(cells, "value", ["n", "kind"])
    return running.finish(ingest.drain(sums, "running", "complete"))


@query(
    "stream_windowed_cells",
    """SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(value) AS count, avg(value) AS S_mean, stddev_samp(value) AS S_std,
       stddev_samp(value) / sqrt(count(value)) AS S_sem FROM events GROUP BY 1, 2""",
    ("S_mean", "S_std", "S_sem"),
)
def stream_windowed_cells(t: Tables) -> DataFrame:
    events = _event_stream(t).withColumn("ts", F.col("ts").cast("timestamp"))
    sums = running.windowed_cells(events, "ts", "value", ["event_type"], "1 day")
    done = running.finish(ingest.drain(sums, "windowed", "update", ["window_start", "event_type"]))
    return done.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "stream_first_zero",
    """SELECT n, p, sample_seed, CASE WHEN tau < 12 THEN tau END AS tau, tau >= 12 AS censored FROM (
         SELECT CAST(o_custkey % 4 AS INTEGER) AS n, month(o_orderdate) / 100 AS p, o_orderkey AS sample_seed, CAST(o_custkey % 15 AS BIGINT) AS tau FROM orders)""",
)
def stream_first_zero(t: Tables) -> DataFrame:
    """Each order is a sample whose series is 1 until ``o_custkey % 15``, recorded up to t = 11."""
    orders = ingest.file_stream(t.spark, t.folder, t.orders.schema, "orders.parquet")
    steps = F.explode(F.sequence(F.lit(0), F.lit(11))).alias("t")
    trace = orders.select(
        (F.col("o_custkey") % 4).cast("int").alias("n"),
        (F.month("o_orderdate") / 100).alias("p"),
        F.col("o_orderkey").alias("sample_seed"),
        (F.col("o_custkey") % 15).alias("stop"),
        steps,
    ).select("n", "p", "sample_seed", F.col("t").cast("bigint").alias("t"), F.when(F.col("t") >= F.col("stop"), 0).otherwise(1).alias("s"))
    return ingest.drain(early_stop.first_zero_table(trace, 11), "first-zero", "update", ["n", "p", "sample_seed"])


@query(
    "stream_gap_fill",
    """SELECT CAST(o_custkey % 4 AS INTEGER) AS n, month(o_orderdate) / 100 AS p, count(*) AS samples FROM orders GROUP BY 1, 2""",
)
def stream_gap_fill(t: Tables) -> DataFrame:
    """Cells of arriving samples that have no stored row yet are counted and stored."""
    orders = ingest.file_stream(t.spark, t.folder, t.orders.schema, "orders.parquet")
    arriving = orders.select((F.col("o_custkey") % 4).cast("int").alias("n"), (F.month("o_orderdate") / 100).alias("p"))
    stored = t.spark.createDataFrame([], "n int, p double, samples bigint")
    target = ingest.scratch(t.spark, "gap-fill")
    stored.write.parquet(target)

    def fill(batch: DataFrame) -> None:
        have = batch.sparkSession.read.schema(stored.schema).parquet(target)
        missing = batch.join(have.select("n", "p"), ["n", "p"], "left_anti")
        missing.groupBy("n", "p").agg(F.count(F.lit(1)).alias("samples")).write.mode("append").parquet(target)

    ingest.fill_gaps(arriving, fill, ingest.scratch(t.spark, "gap-journal")).awaitTermination()
    return t.spark.read.schema(stored.schema).parquet(target)
