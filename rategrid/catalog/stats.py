"""Curves, cell statistics, joins and unions over the samples view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rategrid.catalog import views as V
from rategrid.catalog.base import Tables, query
from rategrid.functions.aliases import ensure_column
from rategrid.functions.columns import fold_dotted, numeric_columns
from rategrid.functions.intervals import wilson_bounds
from rategrid.functions.numeric import finite, skip_nan
from rategrid.functions.predicates import condition, nearest
from rategrid.operators import cellstats, curve as curves, quantiles
from rategrid.sources import runs

FINITE = "isfinite({0})"


def _curve_sql(y: str, where: str = "TRUE", bars: str = "sem", extra: str = "") -> str:
    """Grouped SQL for a curve with the named bars, or the auto choice."""
    z2 = "3.8416"
    return f"""
WITH {V.SAMPLES_SQL}{extra}, rows AS (SELECT n, p, CAST({y} AS DOUBLE) AS y FROM joined WHERE {where}),
g AS (SELECT CAST(n AS BIGINT) AS n, p, avg(y) AS mean, count(y) AS m, sum(y) AS s, stddev_samp(y) AS sd,
             count(*) AS n_samples, min(CASE WHEN y IN (0, 1) THEN 1 ELSE 0 END) AS is01 FROM rows GROUP BY 1, 2),
w AS (SELECT *, s / m AS ph, CASE WHEN m > 1 THEN sd / sqrt(m) ELSE 0 END AS sem, min(is01) OVER () AS all01 FROM g),
b AS (SELECT *, (ph + {z2} / (2 * m)) / (1 + {z2} / m) AS mid,
             1.96 * sqrt(ph * (1 - ph) / m + {z2} / (4.0 * m * m)) / (1 + {z2} / m) AS half FROM w)
SELECT n, p, mean,
       CASE WHEN '{bars}' = 'none' THEN 0.0 WHEN '{bars}' = 'std' THEN CASE WHEN m > 1 THEN sd ELSE 0 END
            WHEN '{bars}' = 'wilson' OR ('{bars}' = 'auto' AND all01 = 1) THEN ph - (mid - half) ELSE sem END AS err_low,
       CASE WHEN '{bars}' = 'none' THEN 0.0 WHEN '{bars}' = 'std' THEN CASE WHEN m > 1 THEN sd ELSE 0 END
            WHEN '{bars}' = 'wilson' OR ('{bars}' = 'auto' AND all01 = 1) THEN mid + half - ph ELSE sem END AS err_high,
       n_samples FROM b"""


PLAIN = ", joined AS (SELECT * FROM samples)"
BARS = ("mean", "err_low", "err_high")


@query("curve_auto_binary", _curve_sql("p_k_gt_0", bars="auto", extra=PLAIN), BARS)
def curve_auto_binary(t: Tables) -> DataFrame:
    return curves.curve(V.samples(t), "obs.p_k_gt_0", error_metric="auto")


@query("curve_auto_continuous", _curve_sql("tmi", "k > 0", "auto", PLAIN), BARS)
def curve_auto_continuous(t: Tables) -> DataFrame:
    return curves.curve(V.samples(t), "obs.tmi", where="obs.k > 0", error_metric="auto")


@query("curve_sem_alias", _curve_sql("CAST(k AS DOUBLE) / n", "n IN (2, 4, 6)", "sem", PLAIN), BARS)
def curve_sem_alias(t: Tables) -> DataFrame:
    return curves.curve(V.samples(t), "k_over_n", sizes=[2, 4, 6], error_metric="sem")


@query("curve_std", _curve_sql("tmi", "abs(p - 0.05) < 1e-9 OR abs(p - 0.1) < 1e-9", "std", PLAIN), BARS)
def curve_std(t: Tables) -> DataFrame:
    return curves.curve(V.samples(t), "obs.tmi", rates=[0.05, 0.1], error_metric="std")


@query("curve_wilson", _curve_sql("p_k_gt_0", "n > 2", "wilson", PLAIN), BARS)
def curve_wilson(t: Tables) -> DataFrame:
    return curves.curve(V.samples(t), "obs.p_k_gt_0", where="n > 2", error_metric="wilson")


@query("curve_no_bars", _curve_sql("entropy_half_cut", bars="none", extra=PLAIN), BARS)
def curve_no_bars(t: Tables) -> DataFrame:
    return curves.curve(V.samples(t), "obs.entropy_half_cut", where=" ", error_metric="none")


JOINED = f""", {V.DISTANCES_SQL}, joined AS (
  SELECT s.*, d.d_cont, d.d_min FROM samples s LEFT JOIN distances d USING (sample_seed))"""


def _joined(t: Tables) -> DataFrame:
    return runs.attach_analyses(V.samples(t), {"distances": V.distances(t)}, keys=["sample_seed"])


@query("curve_joined_analysis", _curve_sql("CAST(d_cont AS DOUBLE) / n", "k > 0", "sem", JOINED), BARS)
def curve_joined_analysis(t: Tables) -> DataFrame:
    return curves.curve(_joined(t), "d_cont_over_n", where="obs.k > 0", error_metric="sem")


@query("curve_bootstrap")
def curve_bootstrap(t: Tables) -> DataFrame:
    return curves.curve(V.samples(t), "obs.k", error_metric="ci95")


@query(
    "curve_bootstrap_near_sem",
    f"""WITH {V.SAMPLES_SQL} SELECT n, p, count(*) AS n_samples, true AS near FROM samples GROUP BY n, p""",
)
def curve_bootstrap_near_sem(t: Tables) -> DataFrame:
    """Do bootstrap half-widths agree with 1.96 standard errors within a quarter (from 100 samples on)?"""
    drawn = curves.curve(V.samples(t), "obs.k", error_metric="ci95")
    plain = curves.curve(V.samples(t), "obs.k", error_metric="sem").select("n", "p", F.col("err_low").alias("sem"))
    width = 1.96 * F.col("sem")
    apart = F.greatest(F.abs(F.col("err_low") - width), F.abs(F.col("err_high") - width))
    near = (F.col("n_samples") < 100) | (apart <= 0.25 * width)
    return drawn.join(plain, ["n", "p"]).select("n", "p", "n_samples", near.alias("near"))


@query(
    "entropy_by_cell",
    f"""WITH {V.SAMPLES_SQL} SELECT n, p, avg(k) AS S_mean, stddev_samp(k) AS S_std, count(k) AS count,
        stddev_samp(k) / sqrt(count(k)) AS S_sem FROM samples GROUP BY n, p""",
    ("S_mean", "S_std", "S_sem"),
)
def entropy_by_cell(t: Tables) -> DataFrame:
    return cellstats.aggregate_entropy(V.samples(t))


# ---------------------------------------------------------------- wide rollup


def _stat_sql(name: str, value: str, integer: bool, quantiles: bool = True) -> str:
    """SQL for every rollup statistic of one column, plain and conditional."""
    z2 = "3.8416"
    parts = []
    for suffix, keep in (("", "TRUE"), ("_cond", "k > 0")):
        v = f"CASE WHEN {keep} THEN CAST({value} AS DOUBLE) END"
        size = f"count(CASE WHEN {keep} THEN 1 END)"
        some = "TRUE" if not suffix else f"{size} > 0"
        sd = f"CASE WHEN {size} > 1 THEN coalesce(stddev_samp({v}), 'NaN'::DOUBLE) ELSE 0.0 END"
        sem = f"CASE WHEN {size} > 1 AND count({v}) > 1 THEN stddev_samp({v}) / sqrt({size}) ELSE 0.0 END"
        stats = {"mean": f"coalesce(avg({v}), 'NaN'::DOUBLE)", "std": sd, "sem": sem}
        if quantiles:
            for q in (0.025, 0.5, 0.975):
                stats[f"q{round(q * 1000):03d}"] = f"coalesce(quantile_cont({v}, {q}), 'NaN'::DOUBLE)"
        if integer:
            m, ph = f"count({v})", f"(sum({v}) / count({v}))"
            mid = f"(({ph} + {z2} / (2 * {m})) / (1 + {z2} / {m}))"
            half = f"(1.96 * sqrt({ph} * (1 - {ph}) / {m} + {z2} / (4.0 * {m} * {m})) / (1 + {z2} / {m}))"
            flag = f"min({v}) >= 0 AND max({v}) <= 1 AND {m} > 0"
            stats["wilson_lower"] = f"CASE WHEN {flag} THEN {mid} - {half} END"
            stats["wilson_upper"] = f"CASE WHEN {flag} THEN {mid} + {half} END"
        parts += [f'CASE WHEN {some} THEN {expr} END AS "{name}_{stat}{suffix}"' for stat, expr in stats.items()]
    return ", ".join(parts)


def _stat_names(name: str, integer: bool, quantiles: bool = True) -> list[str]:
    stats = ["mean", "std", "sem"] + (["q025", "q500", "q975"] if quantiles else [])
    stats += ["wilson_lower", "wilson_upper"] if integer else []
    return [f"{name}_{s}{suffix}" for suffix in ("", "_cond") for s in stats]


ROLLED = [
    ("obs.k", "k", True),
    ("obs.p_k_gt_0", "p_k_gt_0", True),
    ("obs.tmi", "tmi", False),
    ("distances.d_cont", "d_cont", True),
    ("k_over_n", "CAST(k AS DOUBLE) / n", False),
    ("d_min_over_n", "CAST(d_min AS DOUBLE) / n", False),
]


@query(
    "cell_rollup_exact",
    f"""WITH {V.SAMPLES_SQL}{JOINED} SELECT n, p, count(*) AS n_samples,
        count(CASE WHEN k > 0 THEN 1 END) AS n_samples_cond_obs_kgt0,
        {", ".join(_stat_sql(*c) for c in ROLLED)} FROM joined GROUP BY n, p""",
    [s for name, _, integer in ROLLED for s in _stat_names(name, integer)],
)
def cell_rollup_exact(t: Tables) -> DataFrame:
    return cellstats.cell_rollup(_joined(t), columns=[c[0] for c in ROLLED])


@query(
    "cell_rollup_by_run",
    f"""WITH {V.SAMPLES_SQL}{JOINED} SELECT run_id, n, p, count(*) AS n_samples,
        count(CASE WHEN k > 0 THEN 1 END) AS n_samples_cond_obs_kgt0,
        {", ".join(_stat_sql(*c, quantiles=False) for c in ROLLED)} FROM joined GROUP BY run_id, n, p""",
    [s for name, _, integer in ROLLED for s in _stat_names(name, integer, False)],
)
def cell_rollup_by_run(t: Tables) -> DataFrame:
    return cellstats.cell_rollup(
        _joined(t), keys=("run_id", "n", "p"), columns=[c[0] for c in ROLLED], quantiles=()
    )


@query(
    "cell_rollup_missing_condition",
    f"""WITH {V.SAMPLES_SQL} SELECT n, p, count(*) AS n_samples, CAST(0 AS BIGINT) AS n_samples_cond_obs_missinggteq1,
        avg(tmi) AS "obs.tmi_mean", CASE WHEN count(*) > 1 THEN stddev_samp(tmi) ELSE 0 END AS "obs.tmi_std",
        CASE WHEN count(*) > 1 THEN stddev_samp(tmi) / sqrt(count(*)) ELSE 0 END AS "obs.tmi_sem",
        CAST(NULL AS DOUBLE) AS "obs.tmi_mean_cond", CAST(NULL AS DOUBLE) AS "obs.tmi_std_cond",
        CAST(NULL AS DOUBLE) AS "obs.tmi_sem_cond" FROM samples GROUP BY n, p""",
    _stat_names("obs.tmi", False, False),
)
def cell_rollup_missing_condition(t: Tables) -> DataFrame:
    return cellstats.cell_rollup(
        V.samples(t), columns=["obs.tmi"], quantiles=(), condition_column="obs.missing", condition_text=">= 1"
    )


@query(
    "cell_quantiles_exact",
    f"""WITH {V.SAMPLES_SQL} SELECT n, p, count(tmi) AS n_finite, quantile_cont(tmi, 0.025) AS q025,
        quantile_cont(tmi, 0.5) AS q500, quantile_cont(tmi, 0.975) AS q975 FROM samples GROUP BY n, p""",
    ("q025", "q500", "q975"),
)
def cell_quantiles_exact(t: Tables) -> DataFrame:
    found = quantiles.exact_quantiles(V.samples(t).select("n", "p", "obs.tmi"), ["n", "p"], "tmi", cellstats.QUANTILES)
    marks = [F.col("quantiles")[i].alias(name) for i, name in enumerate(("q025", "q500", "q975"))]
    return found.select("n", "p", "n_finite", *marks)


@query(
    "cell_progress",
    f"""WITH {V.SAMPLES_SQL} SELECT n, p, count(*) AS n_samples, avg(k) AS mean_k, avg(final_abar) AS mean_abar,
        avg(runtime_total_s) AS mean_runtime_s FROM samples GROUP BY n, p""",
    ("mean_k", "mean_abar", "mean_runtime_s"),
)
def cell_progress(t: Tables) -> DataFrame:
    return cellstats.progress(V.samples(t))


@query(
    "wilson_by_cell",
    f"""WITH {V.SAMPLES_SQL}, g AS (SELECT n, p, count(*) AS m, sum(p_k_gt_0) AS s, sum(p_k_gt_0) / count(*) AS ph
          FROM samples GROUP BY n, p)
        SELECT n, p, (ph + 3.8416 / (2 * m) - 1.96 * sqrt(ph * (1 - ph) / m + 3.8416 / (4.0 * m * m))) / (1 + 3.8416 / m) AS lower,
               (ph + 3.8416 / (2 * m) + 1.96 * sqrt(ph * (1 - ph) / m + 3.8416 / (4.0 * m * m))) / (1 + 3.8416 / m) AS upper FROM g""",
    ("lower", "upper"),
)
def wilson_by_cell(t: Tables) -> DataFrame:
    low, high = wilson_bounds(F.sum("obs.p_k_gt_0"), F.count("obs.p_k_gt_0"))
    return V.samples(t).groupBy("n", "p").agg(low.alias("lower"), high.alias("upper"))


# ---------------------------------------------------------------- joins, unions, filters, projections


@query(
    "samples_left_join_analysis",
    f"""WITH {V.SAMPLES_SQL}{JOINED} SELECT n, count(*) AS rows, count(d_cont) AS matched,
        CAST(sum(d_cont) AS BIGINT) AS sum_d_cont FROM joined GROUP BY n""",
)
def samples_left_join_analysis(t: Tables) -> DataFrame:
    return _joined(t).groupBy("n").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("distances.d_cont").alias("matched"),
        F.sum("distances.d_cont").cast("bigint").alias("sum_d_cont"),
    )


@query(
    "runs_union_missing_columns",
    f"""WITH {V.SAMPLES_SQL}, both_runs AS (
          SELECT run_id, n, p, k, tmi FROM samples WHERE run_id <> 'R'
          UNION ALL SELECT run_id, n, p, k, NULL FROM samples WHERE run_id = 'R')
        SELECT n, p, count(*) AS rows, count(tmi) AS with_tmi, sum(k) AS sum_k, avg(tmi) AS mean_tmi
        FROM both_runs GROUP BY n, p""",
    ("mean_tmi",),
)
def runs_union_missing_columns(t: Tables) -> DataFrame:
    base = V.samples(t)
    flat = base.select("run_id", "n", "p", F.col("obs.k").alias("k"), F.col("obs.tmi").alias("tmi"))
    first = flat.where("run_id <> 'R'")
    second = flat.where("run_id = 'R'").drop("tmi").withColumn("n", F.col("n").cast("bigint"))
    pooled = runs.union_runs([first, second])
    return pooled.groupBy(F.col("n").cast("int").alias("n"), "p").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("tmi").alias("with_tmi"),
        F.sum("k").alias("sum_k"),
        F.avg("tmi").alias("mean_tmi"),
    )


@query(
    "derived_aliases",
    f"""WITH {V.SAMPLES_SQL}{JOINED} SELECT n, avg(CAST(k AS DOUBLE) / n) AS k_over_n,
        avg(CAST(d_cont AS DOUBLE) / n) AS d_cont_over_n, avg(CAST(d_min AS DOUBLE) / n) AS d_min_over_n
        FROM joined GROUP BY n""",
    ("k_over_n", "d_cont_over_n", "d_min_over_n"),
)
def derived_aliases(t: Tables) -> DataFrame:
    df = _joined(t)
    names = ("k_over_n", "d_cont_over_n", "d_min_over_n", "d_logical_min_over_n", "unknown")
    for name in names:
        df = ensure_column(df, name)
    return df.groupBy("n").agg(*[F.avg(c).alias(c) for c in names if c in df.columns])


@query(
    "conditional_predicates",
    f"""WITH {V.SAMPLES_SQL} SELECT n, count(CASE WHEN k >= 5 THEN 1 END) AS gteq5, count(CASE WHEN k <= 5 THEN 1 END) AS lteq5,
        count(CASE WHEN k = 7 THEN 1 END) AS eq7, count(CASE WHEN k <> 7 THEN 1 END) AS neq7,
        count(CASE WHEN k > 20 THEN 1 END) AS gt20, count(CASE WHEN k < 20 THEN 1 END) AS lt20,
        count(*) AS unreadable, count(*) AS missing FROM samples GROUP BY n""",
)
def conditional_predicates(t: Tables) -> DataFrame:
    df = V.samples(t)
    tests = {
        "gteq5": ("obs.k", ">= 5"),
        "lteq5": ("obs.k", "<=5"),
        "eq7": ("obs.k", "== 7"),
        "neq7": ("obs.k", "!= 7"),
        "gt20": ("obs.k", "> 20"),
        "lt20": ("obs.k", " < 20 "),
        "unreadable": ("obs.k", "> many"),
        "missing": ("obs.none", "> 0"),
    }
    return df.groupBy("n").agg(*[F.count_if(condition(df, *args)).alias(name) for name, args in tests.items()])


@query(
    "nearest_rates",
    f"""WITH {V.SAMPLES_SQL}, grid AS (SELECT DISTINCT n, p FROM samples),
        targets AS (SELECT unnest([0.004, 0.042, 0.055, 0.3]) AS target),
        ranked AS (SELECT n, target, p, row_number() OVER (PARTITION BY n, target ORDER BY abs(p - target), p) AS rn
                   FROM grid, targets)
        SELECT n, target, p FROM ranked WHERE rn = 1""",
    ("target", "p"),
)
def nearest_rates(t: Tables) -> DataFrame:
    return nearest(V.samples(t), [0.004, 0.042, 0.055, 0.3], "p", by=["n"])


@query(
    "folded_dotted_columns",
    """SELECT l_linenumber AS n, count(*) AS rows, sum(CAST(l_quantity AS BIGINT)) AS sum_k FROM lineitem
       WHERE l_quantity > 10 AND l_tax < 0.05 GROUP BY l_linenumber""",
)
def folded_dotted_columns(t: Tables) -> DataFrame:
    dotted = t.lineitem.select(
        F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("obs.k"), F.col("l_tax").alias("diag.tax")
    )
    kept = fold_dotted(dotted).where("obs.k > 10 and diag.tax < 0.05")
    return kept.groupBy("n").agg(F.count(F.lit(1)).alias("rows"), F.sum("obs.k").cast("bigint").alias("sum_k"))


@query(
    "numeric_column_means",
    f"""WITH {V.SAMPLES_SQL} SELECT 'obs.k' AS statistic, avg(k) AS value FROM samples
        UNION ALL SELECT 'obs.p_k_gt_0', avg(p_k_gt_0) FROM samples
        UNION ALL SELECT 'obs.tmi', avg(tmi) FROM samples
        UNION ALL SELECT 'obs.entropy_half_cut', avg(entropy_half_cut) FROM samples
        UNION ALL SELECT 'diag.final_abar', avg(final_abar) FROM samples
        UNION ALL SELECT 'diag.runtime_total_s', avg(runtime_total_s) FROM samples
        UNION ALL SELECT 'n', avg(n) FROM samples UNION ALL SELECT 'p', avg(p) FROM samples""",
    ("value",),
    digits=5,
)
def numeric_column_means(t: Tables) -> DataFrame:
    df = V.samples(t).withColumn("identity_holds", F.lit(True))
    means = df.agg(*[F.avg(c).alias(c) for c in numeric_columns(df)])
    return cellstats.tidy(means, keys=[])


# ---------------------------------------------------------------- null, NaN and infinite values


@query(
    "quantiles_with_traps",
    f"""WITH {V.TRAPS_SQL} SELECT n, p, count(*) AS n_finite, quantile_cont(y, 0.025) AS q025, quantile_cont(y, 0.5) AS q500,
        quantile_cont(y, 0.975) AS q975 FROM traps WHERE isfinite(y) GROUP BY 1, 2""",
    ("q025", "q500", "q975"),
)
def quantiles_with_traps(t: Tables) -> DataFrame:
    """Only finite values have ranks."""
    found = quantiles.exact_quantiles(V.traps(t), ["n", "p"], "y", cellstats.QUANTILES)
    return found.select("n", "p", "n_finite", *[F.col("quantiles")[i].alias(c) for i, c in enumerate(("q025", "q500", "q975"))])


@query(
    "trap_counts",
    f"""WITH {V.TRAPS_SQL} SELECT n, count(*) AS rows, count(CASE WHEN isfinite(y) THEN 1 END) AS finite,
        count(CASE WHEN NOT isnan(y) THEN 1 END) AS without_nan, avg(CASE WHEN isfinite(y) THEN y END) AS mean_finite,
        max(CASE WHEN NOT isnan(y) THEN y END) = 'Infinity'::DOUBLE AS inf_kept FROM traps GROUP BY 1""",
    ("mean_finite",),
)
def trap_counts(t: Tables) -> DataFrame:
    """What the finite filter drops and what skipping NaN keeps."""
    y = F.col("y")
    return V.traps(t).groupBy("n").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(finite(y)).alias("finite"),
        F.count(skip_nan(y)).alias("without_nan"),
        F.avg(finite(y)).alias("mean_finite"),
        (F.max(skip_nan(y)) == float("inf")).alias("inf_kept"),
    )
