"""Exact quantiles per group that never hold a whole group in one task.

A sketch only decides where to cut each group's value range.  One pass then counts the
rows between cuts exactly and keeps the values close to a wanted rank; only those are
sorted.  If the sketch was off for some group, that group's interval is narrowed by counted
histograms until one value is left: a poor sketch costs time but never changes a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rategrid.functions.columns import attach_summary, join_on
from rategrid.functions.numeric import finite
from rategrid.session import cut_lineage


class Cuts:
    """Where to cut the value range of a group so that the wanted ranks lie between close cuts."""

    def __init__(self, qs: Sequence[float], accuracy: int = 10_000) -> None:
        self.qs, self.accuracy = [float(q) for q in qs], accuracy
        slack = 2.0 / accuracy
        self.marks = sorted({min(max(q + d, 0.0), 1.0) for q in self.qs for d in (-slack, slack)})
        # even parts lie between cuts, odd parts are the values equal to a cut
        self.near = [
            2 * i
            for i in range(1, len(self.marks))
            if any(abs((self.marks[i - 1] + self.marks[i]) / 2 - q) < slack for q in self.qs)
        ]

    def sketch(self, value: Column) -> Column:
        """Aggregate: the cut points of a column of finite values, null without any."""
        return F.percentile_approx(value, self.marks, self.accuracy)

    def part(self, value: Column, cuts: Column) -> Column:
        above = sum((value > F.get(cuts, F.lit(i))).cast("int") for i in range(len(self.marks)))
        return 2 * above + F.array_contains(cuts, value).cast("int")

    def kept(self, value: Column, part: Column) -> Column:
        """The value itself where it equals a cut or lies next to a wanted rank, else null."""
        return F.when((part % 2 == 1) | part.isin(self.near), value)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    qs: Sequence[float],
    accuracy: int = 10_000,
) -> DataFrame:
    """One row per group with ``n_finite`` and ``quantiles`` (array, order of ``qs``).

    Linear interpolation between neighbouring order statistics; only finite values count,
    and groups without any are left out.
    """
    keys, plan = list(keys), Cuts(qs, accuracy)
    rows = df.select(*keys, finite(F.col(value)).alias("_v")).where(F.col("_v").isNotNull())
    placed = attach_summary(rows, rows.groupBy(*keys).agg(plan.sketch(F.col("_v")).alias("_cuts")), keys)
    parted = placed.select(*keys, "_v", plan.part(F.col("_v"), F.col("_cuts")).alias("_part"))
    return quantiles_of_parts(parted, keys, plan)


def quantiles_of_parts(parted: DataFrame, keys: Sequence[str], plan: Cuts) -> DataFrame:
    """Quantiles per group from ``(keys, _v, _part)``, one row per finite value."""
    keys = list(keys)
    kept = plan.kept(F.col("_v"), F.col("_part")).alias("_v")
    # one row per interval, and one per distinct value next to a wanted rank
    merged = cut_lineage(parted.groupBy(*keys, "_part", kept).agg(F.count(F.lit(1)).alias("_copies")))
    parts = merged.groupBy(*keys, "_part").agg(F.sum("_copies").alias("_size"), F.first("_v").isNotNull().alias("_kept"))
    whole = Window.partitionBy(*keys)  # the parts of one group: two per mark at most
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).withColumn(
        "n_finite", F.sum("_size").over(whole)
    )
    last = F.col("n_finite") - 1
    ranks = [end(F.lit(q) * last).cast("bigint") for q in plan.qs for end in (F.floor, F.ceil)]
    targets = parts.withColumn("_wants", F.array_distinct(F.array(*ranks))).withColumn(
        "_wants", F.filter("_wants", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_size")))
    )
    chosen = cut_lineage(targets.where(F.size("_wants") > 0).select(*keys, "_part", "n_finite", "_kept", "_before", "_wants"))

    on = [*keys, "_part"]
    wanted = chosen.select(*on, "_before", "_wants")
    detail = attach_summary(merged.where("_v is not null").select(*on, "_v", "_copies"), wanted, on, ready=True)
    narrowed = None
    missed = chosen.where(~F.col("_kept")).select(*on, "_before", "_wants")
    if not missed.isEmpty():
        asked = missed.select(*on, F.explode("_wants").alias("_rank"), "_before")
        late = ranked_values(parted.select(*on, "_v"), asked, on)
        narrowed = late.select(*keys, "_v", "_rank")
    upto = Window.partitionBy(*on).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = detail.withColumn("_end", F.col("_before") + F.sum("_copies").over(upto))
    hits = ranked.select(*keys, "_v", "_end", "_copies", F.explode("_wants").alias("_rank")).where(
        (F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_copies"))
    )
    hits = hits.select(*keys, "_v", "_rank")
    if narrowed is not None:
        hits = hits.unionByName(narrowed)
    # at most two ranks per quantile
    found = hits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_found"))
    totals = chosen.groupBy(*keys).agg(F.first("n_finite").alias("n_finite"))
    joined = join_on(found, totals, keys)

    def interpolated(q: float) -> Column:
        position = F.lit(q) * last
        low = F.col("_found")[F.floor(position).cast("bigint")]
        high = F.col("_found")[F.ceil(position).cast("bigint")]
        return low + (high - low) * (position - F.floor(position))

    return joined.select(*keys, "n_finite", F.array(*[interpolated(q) for q in plan.qs]).alias("quantiles"))


def ranked_values(rows: DataFrame, asked: DataFrame, on: Sequence[str], bins: int = 256) -> DataFrame:
    """The values at given ranks: ``on, _rank, _v`` for every row ``on, _rank, _before`` of ``asked``.

    ``_before`` rows of the group sort before all of ``rows(on, _v)``.  Each step counts one histogram per rank between
    the least and the largest value still possible and goes on with the bin that holds the rank, so no group is sorted
    and a task holds counts only.  Both ends lie in bins of their own, hence every step narrows.
    """
    at = [*on, "_rank"]
    ends = rows.groupBy(*on).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    state = cut_lineage(join_on(asked, ends, on))
    found = None
    while True:
        done = state.where("_low = _high").select(*at, F.col("_low").alias("_v"))
        found = done if found is None else found.unionByName(done)
        ahead = state.where("_low < _high")
        if ahead.isEmpty():
            return found
        # the rows between any two ends are read once for all ranks of their group
        groups = ahead.groupBy(*on).agg(F.collect_list(F.struct("_rank", "_before", "_low", "_high")).alias("_asked"))
        rows = attach_summary(rows.select(*on, "_v"), groups, on)
        inside = F.filter("_asked", lambda s: F.col("_v").between(s["_low"], s["_high"]))
        rows = cut_lineage(rows.select(*on, "_v", inside.alias("_asked")).where(F.size("_asked") > 0))
        spread = rows.select(*on, "_v", F.inline("_asked"))
        width = F.col("_high") / 4 - F.col("_low") / 4  # quarters, so that no difference overflows
        share = F.when(width > 0, (F.col("_v") / 4 - F.col("_low") / 4) / width).otherwise((F.col("_v") > F.col("_low")).cast("double"))
        counted = spread.groupBy(*at, "_before", F.floor(share * bins).alias("_bin")).agg(
            F.count(F.lit(1)).alias("_size"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
        )
        upto = Window.partitionBy(*at).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)  # bins + 1 rows at most
        summed = counted.withColumn("_upto", F.col("_before") + F.sum("_size").over(upto))
        hit = (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_size"))
        state = cut_lineage(summed.where(hit).select(*at, (F.col("_upto") - F.col("_size")).alias("_before"), "_low", "_high"))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, alias: str = "median") -> DataFrame:
    found = exact_quantiles(df, keys, value, [0.5])
    return found.select(*keys, F.col("quantiles")[0].alias(alias))
