"""Time series, crossings and grid queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rategrid.catalog import views as V
from rategrid.catalog.base import Tables, query
from rategrid.operators import cellstats, crossing, ranks, survival

# ---------------------------------------------------------------- time series


@query(
    "trace_positions",
    f"WITH {V.TRACE_SQL} SELECT sample_seed, t, s FROM trace",
)
def trace_positions(t: Tables) -> DataFrame:
    return V.event_trace(t).select("sample_seed", "t", "s")


BAND_SQL = """SELECT n, p, t, s1 / m AS mean_s, sem, m AS n_samples, least(greatest(s1 / m - sem, 0.0), 1.0) AS low,
   least(greatest(s1 / m + sem, 0.0), 1.0) AS high
 FROM (SELECT *, CASE WHEN m > 1 THEN sqrt(greatest(s1 - s1 * s1 / m, 0.0) / (m - 1)) / sqrt(m) ELSE 0 END AS sem FROM sums)"""


@query(
    "survival_padded",
    f"""WITH {V.TRACE_SQL}, totals AS (SELECT n, p, count(DISTINCT sample_seed) AS m FROM trace GROUP BY n, p),
        sums AS (SELECT n, p, t, CAST(sum(s) AS DOUBLE) AS s1, any_value(m) AS m FROM trace JOIN totals USING (n, p)
                 GROUP BY n, p, t) {BAND_SQL}""",
    ("mean_s", "sem", "low", "high"),
)
def survival_padded(t: Tables) -> DataFrame:
    return survival.survival_band(V.event_trace(t))


@query(
    "survival_observed_over_n",
    f"""WITH {V.TRACE_SQL}, sums AS (SELECT n, p, t, CAST(sum(s) AS DOUBLE) AS s1, count(s) AS m FROM trace
          GROUP BY n, p, t) SELECT *, t / n AS t_over_n FROM ({BAND_SQL})""",
    ("mean_s", "sem", "low", "high", "t_over_n"),
)
def survival_observed_over_n(t: Tables) -> DataFrame:
    return survival.rescaled(survival.survival_band(V.event_trace(t), padded=False))


@query(
    "sample_first_zero",
    f"""WITH {V.TRACE_SQL} SELECT n, p, sample_seed, min(CASE WHEN s = 0 THEN t END) AS tau, max(t) AS last_t
        FROM trace GROUP BY n, p, sample_seed""",
)
def sample_first_zero(t: Tables) -> DataFrame:
    return survival.sample_times(V.event_trace(t))


def _tau_sql(source: str, table: str) -> str:
    return f"""
WITH {source}, totals AS (SELECT n, p, count(DISTINCT sample_seed) AS m FROM {table} GROUP BY n, p),
curve AS (SELECT n, p, t, sum(s) / any_value(m) AS ms FROM {table} JOIN totals USING (n, p) GROUP BY n, p, t),
lagged AS (SELECT *, lag(ms) OVER (PARTITION BY n, p ORDER BY t) AS ms0, lag(t) OVER (PARTITION BY n, p ORDER BY t) AS t0, row_number() OVER (PARTITION BY n, p ORDER BY t) AS i FROM curve),
firsts AS (SELECT *, row_number() OVER (PARTITION BY n, p ORDER BY t) AS hit FROM lagged WHERE ms <= 0.5),
taus AS (SELECT n, p, CASE WHEN i = 1 THEN 0.0 WHEN ms0 = ms THEN t ELSE t0 + (ms0 - 0.5) / (ms0 - ms) * (t - t0) END AS tau_interp
         FROM firsts WHERE hit = 1),
per AS (SELECT n, p, sample_seed, min(CASE WHEN s = 0 THEN t END) AS tau, max(t) AS last_t FROM {table} GROUP BY n, p, sample_seed),
stats AS (SELECT n, p, avg(tau) AS tau_mean, CASE WHEN count(tau) > 1 THEN stddev_samp(tau) WHEN count(tau) = 1 THEN 0.0 END AS tau_std,
                 count(tau) AS n_purified, count(*) AS n_total, max(last_t) AS cap FROM per GROUP BY n, p)
SELECT n, p, tau_interp, tau_interp / n AS tau_interp_over_n, tau_mean, tau_std,
       CASE WHEN n_purified > 0 THEN tau_std / sqrt(n_purified) END AS tau_sem, tau_mean / n AS tau_mean_over_n,
       CASE WHEN n_purified > 0 THEN tau_std / sqrt(n_purified) / n END AS tau_sem_over_n, tau_mean AS tau, tau_mean / n AS tau_over_n,
       n_purified, n_total, 1.0 - n_purified / greatest(n_total, 1) AS censor_frac, CAST(cap AS BIGINT) AS cap, n_purified = 0 AS capped
FROM stats LEFT JOIN taus USING (n, p)"""


TAU_DOUBLES = (
    "tau_interp tau_interp_over_n tau_mean tau_std tau_sem tau_mean_over_n tau_sem_over_n tau tau_over_n censor_frac"
).split()


@query("tau_table_events", _tau_sql(V.TRACE_SQL, "trace"), TAU_DOUBLES)
def tau_table_events(t: Tables) -> DataFrame:
    return survival.tau_table(V.event_trace(t))


# two runs whose samples share seeds: even and odd users
RUNS_SQL = V.TRACE_SQL.replace("trace AS", "one_run AS") + """, trace AS (
  SELECT CAST((user_id // 2) % 4 AS INTEGER) + 1 AS n, CAST((user_id // 2) % 5 AS DOUBLE) / 10 AS p, user_id AS sample_seed, t, s
  FROM (SELECT sample_seed AS user_id, t, s FROM one_run))"""


def run_trace(t: Tables) -> DataFrame:
    user = F.col("sample_seed")
    seed = F.floor(user / 2)
    return V.event_trace(t).select(
        (user % 2).alias("run_id"),
        ((seed % 4).cast("int") + 1).alias("n"),
        ((seed % 5).cast("double") / 10).alias("p"),
        seed.alias("sample_seed"),
        "t",
        "s",
    )


@query(
    "survival_pooled_runs",
    f"""WITH {RUNS_SQL}, totals AS (SELECT n, p, count(DISTINCT sample_seed) AS m FROM trace GROUP BY n, p),
        sums AS (SELECT n, p, t, CAST(sum(s) AS DOUBLE) AS s1, any_value(m) AS m FROM trace JOIN totals USING (n, p)
                 GROUP BY n, p, t) {BAND_SQL}""",
    ("mean_s", "sem", "low", "high"),
)
def survival_pooled_runs(t: Tables) -> DataFrame:
    return survival.survival_band(run_trace(t))


@query("tau_pooled_runs", _tau_sql(RUNS_SQL, "trace"), TAU_DOUBLES)
def tau_pooled_runs(t: Tables) -> DataFrame:
    return survival.tau_table(run_trace(t))


SPARSE_SQL = V.TRACE_SQL.replace("trace AS", "dense AS") + ", trace AS (SELECT n, p, sample_seed, 3 * t AS t, s FROM dense)"


@query("tau_sparse_times", _tau_sql(SPARSE_SQL, "trace"), TAU_DOUBLES)
def tau_sparse_times(t: Tables) -> DataFrame:
    return survival.tau_table(V.event_trace(t).withColumn("t", 3 * F.col("t")))


@query("tau_table_padded_arrays", _tau_sql(V.BITS_SQL, "bit_rows"), TAU_DOUBLES)
def tau_table_padded_arrays(t: Tables) -> DataFrame:
    padded = V.bit_traces(t).withColumn("s", survival.pad_trace(F.col("s"), F.lit(8)))
    return survival.tau_table(survival.explode_traces(padded))


@query(
    "array_first_zero",
    f"""WITH {V.BITS_SQL} SELECT n, CAST(coalesce(tau, -1) AS BIGINT) AS tau, count(*) AS samples FROM (
          SELECT n, sample_seed, min(CASE WHEN s = 0 AND t <= last_t THEN t END) AS tau
          FROM bit_rows JOIN bit_traces USING (n, p, sample_seed) GROUP BY n, sample_seed) GROUP BY 1, 2""",
)
def array_first_zero(t: Tables) -> DataFrame:
    tau = F.coalesce(survival.first_zero(F.col("s")), F.lit(-1)).cast("bigint")
    return V.bit_traces(t).groupBy("n", tau.alias("tau")).agg(F.count(F.lit(1)).alias("samples"))


# ---------------------------------------------------------------- crossings

AGG_SQL = V.GRID_SQL + """,
agg AS (SELECT run_id, n, p, avg(k) AS S, stddev_samp(k) / sqrt(count(k)) AS S_sem, count(k) AS count
        FROM grid_samples GROUP BY run_id, n, p)"""
POOLED_SQL = V.GRID_SQL + """,
agg AS (SELECT 0 AS run_id, n, p, avg(k) AS S, count(k) AS count FROM grid_samples GROUP BY n, p)"""

ALIGN_SQL = """ranked AS (SELECT *, dense_rank() OVER (PARTITION BY run_id ORDER BY n DESC) AS size_rank FROM agg),
both_sizes AS (SELECT run_id, p, max(CASE WHEN size_rank = 1 THEN S END) AS a, max(CASE WHEN size_rank = 2 THEN S END) AS b
         FROM ranked WHERE size_rank <= 2 GROUP BY run_id, p),
neighbours AS (SELECT *,
  max(CASE WHEN a IS NOT NULL THEN p END) OVER (PARTITION BY run_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS a0,
  min(CASE WHEN a IS NOT NULL THEN p END) OVER (PARTITION BY run_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a1,
  max(CASE WHEN b IS NOT NULL THEN p END) OVER (PARTITION BY run_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS b0,
  min(CASE WHEN b IS NOT NULL THEN p END) OVER (PARTITION BY run_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b1
  FROM both_sizes),
filled AS (SELECT c.run_id, c.p,
  CASE WHEN c.a IS NOT NULL THEN c.a WHEN a0 IS NULL THEN ra.a WHEN a1 IS NULL THEN la.a
       ELSE la.a + (ra.a - la.a) * (c.p - a0) / (a1 - a0) END AS s_big,
  CASE WHEN c.b IS NOT NULL THEN c.b WHEN b0 IS NULL THEN rb.b WHEN b1 IS NULL THEN lb.b
       ELSE lb.b + (rb.b - lb.b) * (c.p - b0) / (b1 - b0) END AS s_small
  FROM neighbours c LEFT JOIN both_sizes la ON la.run_id = c.run_id AND la.p = a0 LEFT JOIN both_sizes ra ON ra.run_id = c.run_id AND ra.p = a1
  LEFT JOIN both_sizes lb ON lb.run_id = c.run_id AND lb.p = b0 LEFT JOIN both_sizes rb ON rb.run_id = c.run_id AND rb.p = b1)"""

PC_SQL = """d AS (SELECT run_id, p, s_big - s_small AS d, row_number() OVER (PARTITION BY run_id ORDER BY p) AS i FROM filled),
steps AS (SELECT x.run_id, x.i, x.p, x.d, y.p AS p1, y.d AS d1,
   (SELECT w.d FROM d w WHERE w.run_id = x.run_id AND w.i = x.i - 1) AS d_before,
   (SELECT arg_max(w.d, w.i) FROM d w WHERE w.run_id = x.run_id AND w.i < x.i AND abs(w.d) >= 1e-12) AS d_earlier
   FROM d x JOIN d y ON y.run_id = x.run_id AND y.i = x.i + 1 WHERE abs(x.d) >= 1e-12 AND abs(y.d) >= 1e-12),
crossings AS (SELECT run_id, arg_min(p - d * (p1 - p) / (d1 - d), i) AS p_crossing FROM steps
   WHERE sign(CASE WHEN abs(d_before) < 1e-12 THEN coalesce(d_earlier, d) ELSE d END) * sign(d1) < 0 GROUP BY run_id),
big AS (SELECT *, lag(p) OVER w AS p0, lag(S) OVER w AS S0 FROM ranked WHERE size_rank = 1 WINDOW w AS (PARTITION BY run_id ORDER BY p)),
halves AS (SELECT run_id, arg_min(CASE WHEN S0 IS NULL OR S0 = S THEN p ELSE p0 + (S0 - 0.5) / (S0 - S) * (p - p0) END, p) AS p_half
   FROM big WHERE S <= 0.5 GROUP BY run_id),
estimates AS (SELECT g.run_id, p_crossing, p_half, coalesce(p_crossing, p_half) AS p_c FROM (SELECT DISTINCT run_id FROM agg) g
   LEFT JOIN crossings USING (run_id) LEFT JOIN halves USING (run_id))"""


def _agg(t: Tables) -> DataFrame:
    return cellstats.aggregate_entropy(V.grid_samples(t), "k", ("run_id", "n", "p"))


@query("curves_aligned", f"WITH {AGG_SQL}, {ALIGN_SQL} SELECT *, s_big - s_small AS diff FROM filled", ("s_big", "s_small", "diff"))
def curves_aligned(t: Tables) -> DataFrame:
    return crossing.aligned_curves(_agg(t), ["run_id"])


@query("crossing_by_run", f"WITH {AGG_SQL}, {ALIGN_SQL}, {PC_SQL} SELECT run_id, p_crossing FROM estimates", ("p_crossing",))
def crossing_by_run(t: Tables) -> DataFrame:
    return crossing.crossing_rate(_agg(t), ["run_id"])


@query("halving_by_run", f"WITH {AGG_SQL}, {ALIGN_SQL}, {PC_SQL} SELECT run_id, p_half FROM estimates", ("p_half",))
def halving_by_run(t: Tables) -> DataFrame:
    return crossing.halving_rate(_agg(t), ["run_id"])


@query("critical_rate_by_run", f"WITH {AGG_SQL}, {ALIGN_SQL}, {PC_SQL} SELECT run_id, p_c FROM estimates", ("p_c",))
def critical_rate_by_run(t: Tables) -> DataFrame:
    return crossing.critical_rate(_agg(t), "crossing", ["run_id"])


@query("critical_rate_pooled", f"WITH {POOLED_SQL}, {ALIGN_SQL}, {PC_SQL} SELECT p_c FROM estimates", ("p_c",))
def critical_rate_pooled(t: Tables) -> DataFrame:
    return crossing.critical_rate(cellstats.aggregate_entropy(V.grid_samples(t), "k"))


@query(
    "peak_rate_by_size",
    f"WITH {AGG_SQL} SELECT run_id, n, arg_max(p, S) AS p_peak FROM (SELECT * FROM agg ORDER BY p) GROUP BY run_id, n",
    ("p_peak",),
)
def peak_rate_by_size(t: Tables) -> DataFrame:
    return crossing.peak_rate(_agg(t), "S_mean", ["run_id", "n"])


@query(
    "curve_summary",
    f"""WITH {POOLED_SQL} SELECT list_sort(list(DISTINCT CAST(n AS BIGINT))) AS sizes, min(p) AS p_min, max(p) AS p_max,
        count(DISTINCT p) AS n_p, CAST(sum(count) AS BIGINT) AS total_samples,
        count(DISTINCT n) * count(DISTINCT p) AS total_cells FROM agg""",
    ("p_min", "p_max"),
)
def curve_summary(t: Tables) -> DataFrame:
    return crossing.curve_summary(cellstats.aggregate_entropy(V.grid_samples(t), "k"))


@query(
    "grid_thinned",
    f"""WITH {V.TRACE_SQL}, grid AS (SELECT DISTINCT n, t FROM trace),
        pos AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY n) AS m FROM grid),
        marks AS (SELECT DISTINCT n, CAST(round_even(j * ((m - 1) / 14.0), 0) AS BIGINT) AS i FROM (SELECT DISTINCT n, m FROM pos), (SELECT unnest(range(0, 15)) AS j))
        SELECT n, t FROM pos JOIN marks USING (n, i) WHERE m > 15 UNION ALL SELECT n, t FROM pos WHERE m <= 15""",
)
def grid_thinned(t: Tables) -> DataFrame:
    return ranks.thin(V.event_trace(t).select("n", "t").distinct(), "t", 15, by=["n"])
