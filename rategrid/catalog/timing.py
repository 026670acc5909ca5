"""Timing-record queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rategrid.catalog import views as V
from rategrid.catalog.base import Tables, query
from rategrid.operators import cellstats, timings

ROLL_SQL = V.TIMINGS_SQL + """, cells AS (
  SELECT model, n, p, avg(time) AS t_mean, stddev_pop(time) AS t_std, median(time) AS t_median, avg(k) AS k_mean, stddev_pop(k) AS k_std,
         avg(CASE WHEN k > 0 THEN 1.0 ELSE 0.0 END) AS Pk, coalesce(avg(abar) FILTER (abar > 0), 0) AS abar_mean,
         coalesce(stddev_pop(abar) FILTER (abar > 0), 0) AS abar_std, avg(k / n) AS rate, count(*) AS count
  FROM timings GROUP BY model, n, p)"""
ROLL_DOUBLES = ("t_mean", "t_std", "t_median", "k_mean", "k_std", "Pk", "abar_mean", "abar_std", "rate")


@query("timing_rollup", f"WITH {ROLL_SQL} SELECT * FROM cells", ROLL_DOUBLES)
def timing_rollup(t: Tables) -> DataFrame:
    return timings.timing_rollup(V.timings(t))


def _cells(t: Tables) -> DataFrame:
    """The rollup without medians, for queries that need only means."""
    return V.timings(t).groupBy("model", "n", "p").agg(
        F.avg("time").alias("t_mean"),
        F.coalesce(F.avg(F.when(F.col("abar") > 0, F.col("abar"))), F.lit(0.0)).alias("abar_mean"),
        F.avg(F.when(F.col("k") > 0, 1.0).otherwise(0.0)).alias("Pk"),
    )


@query(
    "scaling_exponents",
    f"""WITH {ROLL_SQL} SELECT model, p, count(*) AS sizes, regr_slope(ln(t_mean), ln(n)) AS gamma_t,
        regr_slope(ln(greatest(abar_mean, 0.1)), ln(n)) AS gamma_abar FROM cells WHERE t_mean > 0 GROUP BY model, p HAVING count(*) >= 4""",
    ("gamma_t", "gamma_abar"),
)
def scaling_exponents(t: Tables) -> DataFrame:
    return timings.scaling_exponents(_cells(t))


@query(
    "normalised_costs",
    f"""WITH {ROLL_SQL}, deep AS (SELECT *, CASE WHEN model = 'NN' THEN 8 * n ELSE 8 * greatest(CAST(ceil(log2(n)) AS INTEGER), 1) END AS depth FROM cells)
        SELECT model, n, p, t_mean, abar_mean, Pk, t_mean / depth AS t_per_layer, t_mean / (n * n) AS t_over_n2,
               t_mean / (depth * n // 2) AS t_per_gate, abar_mean / n AS abar_over_n FROM deep""",
    ("t_mean", "abar_mean", "Pk", "t_per_layer", "t_over_n2", "t_per_gate", "abar_over_n"),
)
def normalised_costs(t: Tables) -> DataFrame:
    return timings.normalised_costs(_cells(t))


@query(
    "paired_time_ratio",
    f"""WITH {ROLL_SQL} SELECT n, p, a.t_mean AS t_a, b.t_mean AS t_b, b.t_mean / a.t_mean AS ratio
        FROM (SELECT * FROM cells WHERE model = 'NN') a JOIN (SELECT * FROM cells WHERE model = 'ATA') b USING (n, p)""",
    ("t_a", "t_b", "ratio"),
)
def paired_time_ratio(t: Tables) -> DataFrame:
    cells = _cells(t)
    return timings.paired_ratio(cells.where("model = 'NN'"), cells.where("model = 'ATA'"))


@query(
    "models_side_by_side",
    f"""WITH {ROLL_SQL} SELECT n, p, max(CASE WHEN model = 'NN' THEN t_mean END) AS "NN",
        max(CASE WHEN model = 'ATA' THEN t_mean END) AS "ATA" FROM cells GROUP BY n, p""",
    ("NN", "ATA"),
)
def models_side_by_side(t: Tables) -> DataFrame:
    return timings.side_by_side(_cells(t), ["NN", "ATA"])


@query(
    "seed_rollup",
    """SELECT l_linenumber AS n, l_discount AS p, avg(l_extendedprice) AS t_a, avg(l_extendedprice * (1 + l_tax)) AS t_b,
        arg_min(l_orderkey % 7, l_orderkey) AS k, count(*) AS verified, count(*) FILTER (l_quantity <= 49) AS passed,
        bool_and(l_quantity <= 49) AS all_match, avg(l_extendedprice * (1 + l_tax)) / avg(l_extendedprice) AS speedup
        FROM lineitem GROUP BY 1, 2""",
    ("t_a", "t_b", "speedup"),
)
def seed_rollup(t: Tables) -> DataFrame:
    runs = t.lineitem.select(
        F.col("l_linenumber").alias("n"),
        F.col("l_discount").alias("p"),
        F.col("l_orderkey").alias("seed"),
        (F.col("l_orderkey") % 7).alias("k"),
        F.col("l_extendedprice").alias("first_time"),
        (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("second_time"),
        (F.col("l_quantity") <= 49).alias("match"),
    )
    return timings.seed_rollup(runs, "first_time", "second_time", "match")


RATES = [round(0.01 * i, 2) for i in range(12)]
MATRIX_SQL = ", ".join(
    f"""coalesce(max(CASE WHEN abs(p - {r}) < 1e-9 THEN Pk END), 'NaN'::DOUBLE) AS "p={r:.4f}\"""" for r in RATES
)


@query(
    "heat_map_matrix",
    f"WITH {ROLL_SQL} SELECT model, n, {MATRIX_SQL} FROM cells GROUP BY model, n",
    [f"p={r:.4f}" for r in RATES],
)
def heat_map_matrix(t: Tables) -> DataFrame:
    return timings.matrix(_cells(t), "Pk", RATES, by=["model"])


def _three(value: str) -> str:
    """SQL of ``value`` rounded to three digits, ties away from zero as the operator prints them."""
    return f"CAST(round(CAST({value} AS DECIMAL(28, 12)), 3) AS DOUBLE)"


TABLE_SQL = ", ".join(
    f"""coalesce(max(CASE WHEN n = {n} THEN CASE WHEN sem IS NULL THEN printf('%.3f', {_three("m")})
        ELSE printf('%.3f ± %.3f', {_three("m")}, {_three("sem")}) END END), '---') AS "n={n}\""""
    for n in range(1, 8)
)


@query(
    "value_table",
    f"""WITH {V.SAMPLES_SQL}, g AS (SELECT n, p, avg(tmi) AS m, stddev_samp(tmi) / sqrt(count(tmi)) AS sem FROM samples GROUP BY n, p),
        grid AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i, count(*) OVER () AS c FROM (SELECT DISTINCT p FROM g)),
        marks AS (SELECT DISTINCT CAST(round_even(j * ((c - 1) / 5.0), 0) AS BIGINT) AS i FROM (SELECT DISTINCT c FROM grid), (SELECT unnest(range(0, 6)) AS j))
        SELECT printf('%.4f', p) AS p, {TABLE_SQL} FROM g JOIN (SELECT p FROM grid JOIN marks USING (i)) USING (p) GROUP BY p""",
)
def value_table(t: Tables) -> DataFrame:
    agg = cellstats.aggregate_entropy(V.samples(t), "obs.tmi")
    return timings.value_table(agg, sizes=range(1, 8), max_rows=6)
