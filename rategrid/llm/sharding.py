"""Sharding: balanced label propagation, then exactly even shards with gapless slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rategrid.llm.storage import stage
from rategrid.llm.text import digest, whole


def _ranked(rows: DataFrame, group: str, order: Column, buckets: int) -> DataFrame:
    """Adds ``rank``: 0, 1, ... inside ``group``, by ``order`` (a small int), without sorting a group in one task.

    Rows fall into ``buckets`` by hash of ``node``; counts of (group, order, bucket) give each bucket its first rank, and
    only a bucket is sorted.  The table of counts has at most groups x orders x buckets rows.
    """
    spread = rows.withColumn("_order", order).withColumn("_bucket", F.pmod(F.xxhash64("node"), F.lit(buckets)))
    counts = spread.groupBy(group, "_order", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(group).orderBy("_order", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("_first", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    inside = Window.partitionBy(group, "_order", "_bucket").orderBy("node")
    placed = spread.withColumn("_at", F.row_number().over(inside) - 1)
    return placed.join(first, [group, "_order", "_bucket"]).withColumn("rank", F.col("_first") + F.col("_at")).drop(
        "_order", "_bucket", "_first", "_at"
    )


def _quota(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def _lookup(values: list[int], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), key.cast("int") + 1)


def propagate(nodes: DataFrame, edges: DataFrame, shards: int, buckets: int = 256) -> DataFrame:
    """Labels of the linked nodes after balanced label propagation: ``node, shard``.

    ``nodes`` has ``node`` (a unique long); ``edges`` has ``a, b`` in both directions.  Every round each node prefers the
    shard that most of its neighbours have (ties: the lowest number); those who gain move, as many into each shard as its
    quota leaves room, lowest hash first.  Seeds (nodes below all their neighbours) and the others take turns, so the two
    ends of a link to a seed never swap places.  It ends when a turn of each has not lowered the number of cut edges.  A
    shard holds at most its even share of all nodes, so later filling can make sizes exactly even.
    """
    total = nodes.count()
    quota = _quota(total, shards)
    least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).join(nodes.select("node"), "node", "left_semi")
    seeded = stage(least.select("node", F.least("node", "b").alias("seed")), "shard-seeds")
    state = stage(_in_a_row(seeded, shards, buckets), "shard-labels")
    best, fewest, idle = state, None, 0
    seeds = True
    while True:
        label = state.select(F.col("node").alias("b"), F.col("shard").alias("seen"))
        votes = edges.join(label, "b").groupBy("a", "seen").agg(F.count(F.lit(1)).alias("votes"))
        top = votes.groupBy(F.col("a").alias("node")).agg(
            F.max(F.struct("votes", (-F.col("seen")).alias("low"))).alias("top"),
            F.sum("votes").alias("degree"),
            F.map_from_entries(F.collect_list(F.struct("seen", "votes"))).alias("by_shard"),  # one entry per shard
        )
        own = F.coalesce(F.element_at("by_shard", F.col("shard")), F.lit(0))
        aim = state.join(top, "node").select(
            "node", "seed", "shard", (-F.col("top.low")).alias("to"), (F.col("top.votes") > own).alias("moves"), (F.col("degree") - own).alias("apart")
        )
        aim = stage(aim, "shard-aims")
        cut = aim.agg(F.sum("apart")).first()[0] or 0
        if fewest is None or cut < fewest:
            best, fewest, idle = state, cut, 0
        else:
            idle += 1
        if not cut or idle == 2:
            return best.select("node", "shard")
        held = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        room = [max(quota[s] - held.get(s, 0), 0) for s in range(shards)]
        turn = (F.col("node") == F.col("seed")) == F.lit(seeds)
        movers = _ranked(aim.filter(F.col("moves") & turn).select("node", "to"), "to", F.lit(0), buckets)
        taken = movers.filter(F.col("rank") < _lookup(room, F.col("to"))).select("node", F.col("to").alias("moved"))
        after = state.join(taken, "node", "left").select("node", "seed", F.coalesce("moved", "shard").alias("shard"))
        state = stage(after, "shard-labels")
        seeds = not seeds


def _in_a_row(seeded: DataFrame, shards: int, buckets: int) -> DataFrame:
    """``node, seed, shard``: nodes numbered seed by seed and cut into even shards, at most ``shards`` - 1 seeds apart.

    Sizes of seeds give each its first number, by hash buckets of which only one is sorted in a task; nodes are numbered
    only in seeds that a border divides.
    """
    sizes = stage(seeded.groupBy("seed").agg(F.count(F.lit(1)).alias("size")), "shard-seed-sizes")
    spread = sizes.withColumn("_bucket", F.pmod(F.xxhash64("seed"), F.lit(buckets)))
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    first = spread.groupBy("_bucket").agg(F.sum("size").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    inside = Window.partitionBy("_bucket").orderBy("seed").rowsBetween(Window.unboundedPreceding, -1)
    placed = spread.withColumn("_at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(first.drop("_n"), "_bucket")
    begin = F.col("_first") + F.col("_at")
    share = _quota(sizes.agg(F.sum("size")).first()[0] or 0, shards)

    def shard(number: Column) -> Column:
        borders = [(number >= sum(share[: s + 1])).cast("int") for s in range(shards - 1)]
        return sum(borders, F.lit(0))

    ends = placed.select("seed", begin.alias("begin"), shard(begin).alias("shard"), shard(begin + F.col("size") - 1).alias("last"))
    ends = stage(ends, "shard-seed-places")  # two shuffles below, so that a large seed can be split
    rows = seeded.join(ends, "seed")
    whole_ones = rows.filter("shard = last").select("node", "seed", "shard")
    divided = _ranked(rows.filter("shard < last").select("node", "seed", "begin"), "seed", F.lit(0), buckets)
    return whole_ones.unionByName(divided.select("node", "seed", shard(F.col("begin") + F.col("rank")).alias("shard")))


def fill_evenly(nodes: DataFrame, labels: DataFrame, shards: int, buckets: int = 256) -> DataFrame:
    """``nodes`` with ``shard`` and ``slot``: counts at most one apart, slots gapless from 0.

    Labelled nodes come first in their shard, unlabelled ones start at a hash; what exceeds a shard's quota is numbered
    and fills the free places of the others in order.
    """
    total = nodes.count()
    quota = _quota(total, shards)
    start = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(shards)).cast("int")
    all_nodes = nodes.join(labels, "node", "left").withColumn("loose", F.col("shard").isNull().cast("int"))
    placed = all_nodes.withColumn("shard", F.coalesce("shard", start))
    ranked = stage(_ranked(placed, "shard", F.col("loose"), buckets), "shard-ranks")
    counts = {r["shard"]: r["n"] for r in ranked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    over = [max(counts.get(s, 0) - quota[s], 0) for s in range(shards)]
    free = [max(quota[s] - counts.get(s, 0), 0) for s in range(shards)]
    before = [sum(over[:s]) for s in range(shards)]
    opens = [sum(free[:s]) for s in range(shards)]
    surplus = F.col("rank") - _lookup(quota, F.col("shard")) + _lookup(before, F.col("shard"))
    target = F.lit(0)
    for s in range(shards):
        if free[s]:
            target = F.when(surplus >= opens[s], F.lit(s)).otherwise(target)
    stays = F.col("rank") < _lookup(quota, F.col("shard"))
    base = [min(counts.get(s, 0), quota[s]) for s in range(shards)]
    to = F.when(stays, F.col("shard")).otherwise(target).cast("int")
    slot = F.when(stays, F.col("rank")).otherwise(surplus - _lookup(opens, target) + _lookup(base, target))
    return ranked.select(*[c for c in ranked.columns if c not in ("shard", "rank", "loose")], to.alias("shard"), slot.cast("long").alias("slot"))


def shard_documents(
    docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", buckets: int = 256
) -> DataFrame:
    """Every input row with its shard: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Law ``rows``: shard counts differ by at most one.  Rows with equal texts (null counts as empty) are linked through
    the first of them and move together as far as quotas allow.  Repeated rows are rows of their own, null ids too.
    """
    body = whole("text")
    h1, h2 = digest(body)
    facts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).select(
        "doc_id",
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        h1.alias("h1"),
        h2.alias("h2"),
    )
    nodes = stage(facts, "shard-rows").withColumn("node", F.monotonically_increasing_id())
    nodes = stage(nodes, "shard-nodes")
    hubs = nodes.groupBy("h1", "h2").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    hubs = stage(hubs.select("h1", "h2", "hub"), "shard-hubs")  # two shuffles below, so that a hot text can be split
    spokes = nodes.select("node", "h1", "h2").join(hubs, ["h1", "h2"]).filter("node <> hub")
    one = spokes.select(F.col("node").alias("a"), F.col("hub").alias("b"))
    edges = stage(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))), "shard-edges")
    labels = propagate(nodes, edges, shards, buckets)
    placed = fill_evenly(nodes.select("node", "doc_id", "size", "text_crc32"), labels, shards, buckets)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
