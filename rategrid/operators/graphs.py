"""Graph tables per size: edges, perfect-matching rounds and checks of both.

Rounds are given in closed form by (graph, n, round, i), so a schedule computes its pairs
from columns and needs no join with a table of rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAPHS = ("cycle", "complete")
# pairs made by one task
PAIRS_PER_TASK = 500_000


def check_graph(name: str) -> str:
    if name not in GRAPHS:
        raise ValueError(f"unknown graph {name!r}; known: {GRAPHS}")
    return name


def _canonical(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b).cast("int"), F.greatest(a, b).cast("int")


def canonical_edges(df: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Each undirected edge once, smaller end first."""
    u, v = _canonical(F.col(a), F.col(b))
    return df.select(*by, u.alias("u"), v.alias("v")).distinct()


def _spread(rows: DataFrame, pairs: Column, *by: str) -> DataFrame:
    """Rows that each fan out to so many ``pairs``, over tasks of about ``PAIRS_PER_TASK``.

    A counted number: adaptive coalescing looks at the few rows before they fan out and leaves them in one task.
    """
    total = rows.agg(F.sum(pairs.cast("bigint"))).first()[0] or 0
    return rows.repartition(total // PAIRS_PER_TASK + 1, *by)


def edges(sizes: DataFrame, graph: str) -> DataFrame:
    """Edge table ``(n, u, v)`` for every size in ``sizes(n)``."""
    n = F.col("n")
    if check_graph(graph) == "cycle":
        small = F.raise_error(F.concat(F.lit("a cycle needs n >= 3; got n="), n.cast("string")))
        checked = sizes.select(F.when(n >= 3, n).otherwise(small.cast("int")).cast("int").alias("n"))
        steps = checked.select("n", F.explode(F.sequence(F.lit(0), n - 1)).alias("a"))
        return canonical_edges(steps.withColumn("b", F.pmod(F.col("a") + 1, n)), ["n"])
    first = sizes.where(n >= 2).select(n.cast("int").alias("n"), F.explode(F.sequence(F.lit(0), n - 2)).alias("u"))
    # one row per first vertex before fanning out, so a large size spreads over tasks
    spread = _spread(first, n - 1 - F.col("u"), "n", "u")
    return spread.select("n", F.col("u").cast("int").alias("u"), F.explode(F.sequence(F.col("u") + 1, n - 1)).alias("v"))


def round_count(graph: str, n: Column) -> Column:
    """Number of perfect-matching rounds; null for odd sizes, which have none."""
    rounds = F.lit(2) if check_graph(graph) == "cycle" else n - 1
    return F.when(n % 2 == 0, rounds).cast("int")


def pair_at(graph: str, n: Column, round_: Column, i: Column) -> tuple[Column, Column]:
    """The i-th pair of a round, 0 <= i < n/2."""
    if check_graph(graph) == "cycle":
        start = 2 * i + round_
        return _canonical(start, F.pmod(start + 1, n))
    ring = n - 1
    a = F.when(i == 0, ring).otherwise(F.pmod(round_ + i, ring))
    b = F.when(i == 0, round_).otherwise(F.pmod(round_ - i, ring))
    return _canonical(a, b)


def rounds(sizes: DataFrame, graph: str) -> DataFrame:
    """Table ``(n, round, i, u, v)`` of all rounds for every even size."""
    even = sizes.where("n % 2 = 0").select(F.col("n").cast("int").alias("n"))
    each = even.select("n", F.explode(F.sequence(F.lit(0), round_count(graph, F.col("n")) - 1)).alias("round"))
    spread = _spread(each, F.col("n") / 2, "n", "round")
    slots = spread.select("n", "round", F.explode(F.sequence(F.lit(0), (F.col("n") / 2).cast("int") - 1)).alias("i"))
    u, v = pair_at(graph, F.col("n"), F.col("round"), F.col("i"))
    return slots.select("n", "round", "i", u.alias("u"), v.alias("v"))


def graph_facts(edge_table: DataFrame, round_table: DataFrame) -> DataFrame:
    """Per size: number of edges, largest degree, number of rounds (null without any)."""
    degrees = edge_table.select("n", F.explode(F.array("u", "v")).alias("vertex")).groupBy("n", "vertex").agg(
        F.count(F.lit(1)).alias("_d")
    )
    facts = degrees.groupBy("n").agg(F.max("_d").alias("degree_max"), (F.sum("_d") / 2).cast("bigint").alias("n_edges"))
    counted = round_table.groupBy("n").agg(F.countDistinct("round").alias("chi_prime"))
    return facts.join(counted, "n", "left")


def round_violations(edge_table: DataFrame, round_table: DataFrame) -> DataFrame:
    """Defects of a factorization, no rows if it is valid.

    A round must meet every vertex once, no edge may be used twice, and the rounds must
    use exactly the edges of the graph.
    """
    touched = round_table.select("n", "round", F.explode(F.array("u", "v")).alias("vertex"))
    per_vertex = touched.groupBy("n", "round", "vertex").agg(F.count(F.lit(1)).alias("_c"))
    per_round = per_vertex.groupBy("n", "round").agg(F.count("vertex").alias("_met"), F.count_if(F.col("_c") != 1).alias("_uneven"))
    vertices = per_round.groupBy("n").agg(
        F.sum("_uneven").alias("vertex_not_once"), F.count_if(F.col("_met") != F.col("n")).alias("vertex_missing")
    )
    # both tables meet in one grouping: joins would be sized before the pairs fan out
    pairs = edge_table.select("n", "u", "v", F.lit(1).alias("_e"), F.lit(0).alias("_r")).unionByName(
        round_table.select("n", "u", "v", F.lit(0).alias("_e"), F.lit(1).alias("_r"))
    )
    per_pair = pairs.groupBy("n", "u", "v").agg(F.sum("_e").alias("_e"), F.sum("_r").alias("_r"))
    uses = per_pair.groupBy("n").agg(
        F.count_if(F.col("_r") > 1).alias("edge_repeated"),
        F.sum(F.when(F.col("_r") == 0, F.col("_e")).otherwise(0)).alias("_unused"),
        F.sum(F.when(F.col("_e") == 0, F.col("_r")).otherwise(0)).alias("edge_foreign"),
        F.sum("_r").alias("_used"),
    )
    uses = uses.withColumn("edge_unused", F.when(F.col("_used") > 0, F.col("_unused")).otherwise(0))  # sizes with rounds only

    def tagged(df: DataFrame, *kinds: str) -> DataFrame:
        counts = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("defects")) for kind in kinds])
        return df.select("n", F.inline(counts)).where("defects > 0")

    return tagged(vertices, "vertex_not_once", "vertex_missing").unionByName(
        tagged(uses, "edge_repeated", "edge_unused", "edge_foreign")
    )
