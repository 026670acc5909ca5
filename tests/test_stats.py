"""Statistics: null, NaN, infinity and small groups against numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rategrid.functions import intervals
from rategrid.operators import cellstats, curve, quantiles
from rategrid.operators.bootstrap import bootstrap_interval

NAN, INF = float("nan"), float("inf")
VALUES = {
    "plain": [1.0, 2.0, 4.0, 8.0],
    "single": [3.0],
    "nan": [1.0, NAN, 3.0],
    "inf": [1.0, INF, 3.0],
    "null": [1.0, None, 5.0],
    "gone": [None, NAN],
}


@pytest.fixture(scope="module")
def values(spark):
    rows = [(1, name, v) for name, vs in VALUES.items() for v in vs]
    return spark.createDataFrame(rows, "n int, g string, y double")


def as_array(values):
    return np.array([NAN if v is None else v for v in values])


def same(a, b):
    return (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, rel=1e-12)


@pytest.mark.filterwarnings("ignore")
def test_rollup_follows_numpy(values):
    rows = {r["g"]: r for r in cellstats.cell_rollup(values, keys=("g",), columns=["y"], condition_column="y", condition_text="> 1").collect()}
    for name, vs in VALUES.items():
        data = as_array(vs)
        mean = np.nanmean(data)
        std = np.nanstd(data, ddof=1) if len(data) > 1 else 0.0
        sem = std / math.sqrt(len(data)) if len(data) > 1 and not math.isnan(std) else 0.0
        row = rows[name]
        assert same(row["y_mean"], mean) and same(row["y_std"], std) and same(row["y_sem"], sem)
        finite = data[np.isfinite(data)]
        for q, label in ((0.025, "q025"), (0.5, "q500"), (0.975, "q975")):
            assert same(row[f"y_{label}"], np.quantile(finite, q) if len(finite) else NAN)
        # NaN sorts above every number, null satisfies no condition
        kept = as_array([v for v in vs if v is not None and not v <= 1])
        assert row["n_samples_cond_ygt1"] == len(kept)
        assert row["y_mean_cond"] is None if len(kept) == 0 else same(row["y_mean_cond"], np.nanmean(kept))


def test_wilson_only_for_binary_integers(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 1, 1.0), (2, 5, 1.0)], "n int, b int, f double")
    rows = {r["n"]: r for r in cellstats.cell_rollup(df, keys=("n",), columns=["b", "f"], quantiles=()).collect()}
    assert rows[1]["b_wilson_lower"] is not None and rows[2]["b_wilson_lower"] is None
    assert "f_wilson_lower" not in rows[1].asDict()


def test_wilson_half_of_hundred(spark):
    df = spark.createDataFrame([(i % 2,) for i in range(100)], "v int")
    low, high = intervals.wilson_bounds(F.sum("v"), F.count("v"))
    row = df.agg(low.alias("low"), high.alias("high")).first()
    assert abs(row["low"] - 0.404) < 0.01 and abs(row["high"] - 0.596) < 0.01
    empty = df.where("v > 5").agg(low.alias("low"), high.alias("high")).first()
    assert (empty["low"], empty["high"]) == (0.0, 1.0)


@pytest.mark.parametrize("metric", ["sem", "std", "wilson", "none"])
def test_error_metrics_of_small_groups(values, metric):
    rows = {r["g"]: r for r in curve.aggregate_curve(values.withColumn("x", F.lit(1.0)), "y", "x", metric, by=["g"]).collect()}
    assert rows["gone"]["err_low"] == 0.0 and rows["gone"]["n_samples"] == 2
    if metric == "sem":
        assert rows["plain"]["err_low"] == pytest.approx(np.std(VALUES["plain"], ddof=1) / 2)
        assert rows["single"]["err_high"] == 0.0
        assert rows["inf"]["err_low"] == pytest.approx(1.0)


def test_auto_metric_is_global(spark):
    rows = [(1, 0.1, 0.0), (1, 0.1, 1.0), (2, 0.1, 1.0), (2, 0.1, 0.5)]
    df = spark.createDataFrame(rows, "n int, p double, y double")
    mixed = {r["n"]: r for r in curve.curve(df, "y").collect()}
    assert mixed[1]["err_low"] == pytest.approx(0.5)  # sem, because size 2 is not binary
    binary = curve.curve(df, "y", sizes=[1]).collect()[0]
    assert binary["err_low"] < 0.5


def test_unknown_names(values):
    with pytest.raises(ValueError):
        curve.aggregate_curve(values, "y", "n", "guess")
    with pytest.raises(KeyError):
        curve.aggregate_curve(values, "missing", "n")
    with pytest.raises(ValueError):
        curve.require_rows(values.where("n > 5"))


def test_registered_metric_and_alias(values):
    from rategrid.functions.aliases import DERIVED_ALIASES, register_alias

    intervals.register_error_metric("span", lambda v: (F.avg(v) - F.min(v), F.max(v) - F.avg(v)))
    register_alias("y_twice", "y", "2 * y")
    try:
        rows = curve.aggregate_curve(values.where("g = 'plain'").withColumn("x", F.lit(0.5)), "y_twice", "x", "span").collect()
        assert rows[0]["err_high"] == pytest.approx(16 - 7.5)
    finally:
        del intervals.ERROR_METRICS["span"], DERIVED_ALIASES["y_twice"]


def test_quantiles_with_one_heavy_group(spark):
    rng = np.random.default_rng(0)
    heavy, light = rng.normal(size=20_000), np.repeat([1.0, 2.0, 2.0, 7.0], 50)
    rows = [("heavy", float(v)) for v in heavy] + [("light", float(v)) for v in light]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = [0.0, 0.025, 0.31, 0.5, 0.975, 1.0]
    # a coarse sketch must not change the result
    for accuracy in (50, 10_000):
        got = {r["g"]: r["quantiles"] for r in quantiles.exact_quantiles(df, ["g"], "v", qs, accuracy).collect()}
        assert got["heavy"] == pytest.approx(np.quantile(heavy, qs).tolist())
        assert got["light"] == pytest.approx(np.quantile(light, qs).tolist())


def test_values_at_ranks_by_histograms(spark):
    rng = np.random.default_rng(3)
    near_equal = np.concatenate([1.0 + np.arange(4_000) * 1e-12, rng.normal(size=1_000) * 1e9])  # 80 % in one sketch step
    wide = np.array([-1.7e308, -1.0, 0.0, 5e-324, 1e-300, 2.0, 2.0, 1.7e308])
    groups = {"near": near_equal, "wide": wide, "equal": np.full(30, 7.0), None: np.array([3.0, 1.0])}
    df = spark.createDataFrame([(g, float(v)) for g, values in groups.items() for v in values], "g string, _v double")
    asked = [(g, r, 100) for g, values in groups.items() for r in {100, 100 + len(values) // 2, 99 + len(values)}]
    wanted = spark.createDataFrame(asked, "g string, _rank bigint, _before bigint")
    got = {(r["g"], r["_rank"]): r["_v"] for r in quantiles.ranked_values(df, wanted, ["g"]).collect()}
    assert got == {(g, r): float(np.sort(groups[g])[r - 100]) for g, r, _ in asked}


def test_quantiles_of_values_that_a_sketch_cannot_tell_apart(spark):
    values = np.concatenate([1.0 + np.arange(8_000) * 1e-12, np.arange(2_000) * 1.0])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").selectExpr("1 AS g", "v")
    qs = [0.1, 0.5, 0.9]
    for accuracy in (3, 10_000):
        assert quantiles.exact_quantiles(df, ["g"], "v", qs, accuracy).first()["quantiles"] == pytest.approx(
            np.quantile(values, qs).tolist(), rel=1e-15
        )


def test_bootstrap_is_repeatable_and_close(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(10, 2, size=400)
    df = spark.createDataFrame([("a", float(v)) for v in data] + [("one", 1.0)], "g string, v double")
    got = [{r["g"]: r for r in bootstrap_interval(df, ["g"], "v", chunk_values=c).collect()} for c in (100, 100, 1_000_000)]
    assert got[0]["a"] == got[1]["a"]
    assert (got[0]["one"]["err_low"], got[0]["one"]["err_high"]) == (0.0, 0.0)
    expected = 1.96 * data.std(ddof=1) / 20
    for run in got:  # split over chunks or not, the interval has the same width
        assert run["a"]["err_low"] == pytest.approx(expected, rel=0.15)
        assert run["a"]["err_high"] == pytest.approx(expected, rel=0.15)
