"""Prefix trie of conversations by a depth-band rollup.

Every distinct sequence of first turns is a node, named by a 128-bit digest of the sequence.  Values of nodes are summed
over subtrees in bands of fixed height: a node explodes to its ancestors within its band only.  The roots of the bands
form a smaller trie of their own, whose sums come from the same step one level up; completed totals of a band's root then
go to the band above it.  So a value is copied ``BAND`` times at most on each level, and the rounds grow with the
logarithm of the depth.

A digest is an exclusive or of the hashes of the turns, each with its depth: it can be cut into blocks and put together
again, so a conversation of any length is ranked and hashed in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rategrid.llm.storage import stage
from rategrid.llm.text import whole, words

BAND = 8
BLOCK = 4096  # turns of a conversation that one window ranks and hashes
ID_BITS = 12  # ids of ended conversations are joined in runs of 2^ID_BITS before they are hashed
KEY = ["k1", "k2"]
DIGEST = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def numbered(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, pos, m1, m2, words``: each turn with its place (from 0), the digest of role and text and its words.

    Turns go by ``turn``, null first; equal ones by their digest.  Rows are dealt by range, so the turns of one
    conversation may lie in many partitions, each of which ranks its own.
    """
    said = [whole(role), whole(text)]
    marked = turns.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.xxhash64(*said).alias("m1"),
        F.xxhash64(F.lit(7), *said).alias("m2"),
        F.size(words(said[1])).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.asc_nulls_first("turn"), "m1", "m2"]
    dealt = marked.repartitionByRange("conv_id", *order, "row").drop("row").withColumn("part", F.spark_partition_id())
    dealt = stage(dealt, "trie-turns")
    # of two neighbouring partitions at most one conversation has rows in both: no more rows than partitions
    ends = dealt.groupBy("conv_id").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi")
    tallies = dealt.join(F.broadcast(ends.select("conv_id")), "conv_id").groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = tallies.select("conv_id", "part", F.sum("n").over(earlier).alias("before"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    ranked = dealt.withColumn("inside", inside).join(F.broadcast(before), ["conv_id", "part"], "left")
    pos = F.col("inside") - 1 + F.coalesce("before", F.lit(0))
    return ranked.select("conv_id", pos.cast("long").alias("pos"), "m1", "m2", "words")


def taken(conv_id: Column) -> Column:
    """Turns that a rebuilt conversation takes from the first of its twenty."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 4


def spliced(turns: DataFrame, family: int = 20, most: int = 3, **names: str) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with the first turns of another, as ``(convs, turns)`` for :func:`prefix_trie`.

    The first :func:`taken` turns of conversation ``c - c % family`` stand in place of as many own ones.
    """
    own = stage(numbered(turns, **names), "trie-numbered")
    convs = stage(own.select("conv_id").distinct(), "trie-convs")
    # at most `most` turns of a first conversation go to its family
    heads = own.filter((F.pmod("conv_id", F.lit(family)) == 0) & (F.col("pos") < most))
    spread = heads.withColumn("conv_id", F.explode(F.sequence(F.col("conv_id"), F.col("conv_id") + family - 1)))
    spread = spread.filter(F.col("pos") < taken(F.col("conv_id"))).join(convs, "conv_id", "left_semi")
    rest = own.filter(F.col("pos") >= taken(F.col("conv_id")))
    return convs, rest.unionByName(spread)


def _blocks(rows: DataFrame, value: list[Column], total: list[Column]) -> DataFrame:
    """``conv_id, block`` and what comes before each block that is not a conversation's first."""
    sums = rows.groupBy("conv_id", "block").agg(*value)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("conv_id", "block", *[t.over(earlier).alias(f"b{i}") for i, t in enumerate(total)]).filter("block > 0")


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, k1, k2, p1, p2, words``: the node of each turn and its parent.

    ``turns`` has ``conv_id, pos, m1, m2, words``; depths follow ``pos`` without gaps.
    """
    rows = turns.withColumn("block", F.floor(F.col("pos") / BLOCK))
    inside = Window.partitionBy("conv_id", "block")
    counted = _blocks(rows, [F.count(F.lit(1)).alias("n")], [F.sum("n")])
    depth = F.row_number().over(inside.orderBy("pos")) + F.coalesce("b0", F.lit(0))
    deep = rows.join(counted, ["conv_id", "block"], "left").withColumn("depth", depth.cast("long"))
    hashed = deep.select(
        "conv_id", "block", "depth", "words", F.xxhash64("depth", "m1").alias("h1"), F.xxhash64(F.lit(7), "depth", "m2").alias("h2")
    )
    hashed = stage(hashed, "trie-hashed")
    xors = _blocks(hashed, [F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2")], [F.bit_xor("x1"), F.bit_xor("x2")])
    running = inside.orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = hashed.join(xors, ["conv_id", "block"], "left")
    keyed = joined.select("conv_id", "depth", "words", "h1", "h2", *[
        F.bit_xor(f"h{i}").over(running).bitwiseXOR(F.coalesce(f"b{i - 1}", F.lit(0))).alias(f"k{i}") for i in (1, 2)
    ])
    parents = [F.col(f"k{i}").bitwiseXOR(F.col(f"h{i}")).alias(f"p{i}") for i in (1, 2)]
    return stage(keyed.select("conv_id", "depth", "words", *KEY, *parents), "trie-prefixes")


def _hashing():
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, made = None, None
        for batch in batches:
            out = []
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
                if (k1, k2) == key:
                    made.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, made.hexdigest()))
                key, made = (k1, k2), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, made.hexdigest())], schema=schema)

    return run


def ends_digest(ends: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256``: SHA-256 of the ids that end at a node, ascending and comma-joined.

    Ids are joined in runs first, so that the one task that has to hash a node's ids in order reads a row for a run.
    """
    runs = ends.groupBy(*KEY, F.shiftright("conv_id", ID_BITS).alias("run")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    texts = runs.select(*KEY, "run", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    ordered = texts.repartition(*KEY).sortWithinPartitions(*KEY, "run")
    return ordered.mapInArrow(_hashing(), "k1 long, k2 long, ends_sha256 string")


def _chains(rows: DataFrame, step: int, height: int) -> DataFrame:
    """``conv_id, band, chain``: the nodes of a conversation in each band of a level, from the top."""
    level = rows.filter(F.col("depth") % step == 0)
    listed = F.sort_array(F.collect_list(F.struct("depth", *KEY)))
    return level.groupBy("conv_id", F.floor(F.col("depth") / (step * height)).alias("band")).agg(listed.alias("chain"))


def band_rollup(nodes: DataFrame, rows: DataFrame, values: list[str], deepest: int, height: int = BAND, step: int = 1) -> DataFrame:
    """``k1, k2`` and the sums of ``values`` over each node's subtree.

    ``nodes`` are those at depths divisible by ``step`` with ``conv_id``, one conversation that holds them; ``rows`` are the
    nodes of every conversation (``conv_id, depth, k1, k2``), the root included.
    """
    band = F.floor(F.col("depth") / (step * height))
    chains = stage(_chains(rows, step, height), "trie-chains")
    upwards = nodes.select("conv_id", "depth", band.alias("band"), *values).join(chains, ["conv_id", "band"])
    within = upwards.select(F.explode(F.filter("chain", lambda a: a["depth"] <= F.col("depth"))).alias("a"), *values)
    sums = [F.sum(v).alias(v) for v in values]
    local = within.groupBy(F.col("a.k1").alias("k1"), F.col("a.k2").alias("k2")).agg(*sums)
    if deepest < step * height:
        return local
    local = stage(local, "trie-bands")
    tops = nodes.filter(F.col("depth") % (step * height) == 0).select("conv_id", "depth", *KEY)
    done = band_rollup(tops.join(local, KEY), rows, values, deepest, height, step * height)
    # a completed root goes to every node of its conversation in the band above
    rising = tops.filter("depth > 0").join(done, KEY).select("conv_id", (band - 1).alias("band"), *values)
    risen = rising.join(chains, ["conv_id", "band"]).select(F.explode("chain").alias("a"), *values)
    risen = risen.select("a.k1", "a.k2", *values)
    return local.unionByName(risen).groupBy(*KEY).agg(*sums)


def prefix_trie(convs_and_turns: tuple[DataFrame, DataFrame], height: int = BAND) -> DataFrame:
    """All nodes of the trie: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Takes ``(convs, turns)``: the ids of all conversations, and ``conv_id, pos, m1, m2, words`` as :func:`numbered` gives
    them.  The turn of a node is turn ``depth`` of conversation ``conv_id``, its smallest member.  Null role or text is
    empty; turns without a conversation id belong to none; repeated rows are turns of their own; a conversation
    without turns ends at the root; without conversations there is no node.
    """
    convs, turns = convs_and_turns
    paths = prefixes(turns)
    root = convs.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", *KEY)])
    rows = paths.select("conv_id", "depth", *KEY).unionByName(root)
    made = paths.groupBy("depth", *KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("words").alias("words"),
        *[F.max(p).alias(p) for p in ("p1", "p2")],
    )
    zero = [F.lit(0).cast("long").alias(c) for c in ("depth", *KEY)]
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    top = top.select(*zero, "conv_id", "n_convs", F.lit(0).cast("long").alias("words"), *[F.lit(None).cast("long").alias(p) for p in ("p1", "p2")])
    nodes = stage(made.unionByName(top), "trie-nodes")
    below = nodes.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    known = nodes.join(below, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    saved = (F.col("n_convs") - 1) * F.col("words")
    known = known.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": saved})
    known = stage(known, "trie-values")
    deepest = known.agg(F.max("depth")).first()[0] or 0
    values = ["n_leaves", "saved_tokens"]
    totals = band_rollup(known.select("conv_id", "depth", *KEY, *values), rows, values, deepest, height)
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", *KEY)).alias("x")).select("conv_id", "x.k1", "x.k2")
    ended = ends_digest(last)
    # written, so that the join below can split the children of a hot parent
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    parents = known.filter("depth > 0").select(*KEY, "p1", "p2").join(above, ["p1", "p2"]).select(*KEY, "parent_conv_id")
    full = known.drop(*values).join(totals, KEY).join(ended, KEY, "left").join(parents, KEY, "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return full.select(*KEY, *DIGEST[:-1], F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
