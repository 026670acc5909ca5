"""Near duplicates by bottom-k sketches.

One hash function gives every word shingle a value; the k smallest values of a document are its sketch.  Inverted lists
of retained values propose pairs, the sketch of the union estimates their similarity, and full sets decide.

Lists stay short without a cap.  Documents with equal sets are one class.  If two sketches share at least c values, they
share one among the (size - c + 1) rarest of each, so only those enter the lists (see :func:`least_overlap`); what is
left of a frequent value are documents made of it.  Each document is compared with one hub of its lists first, then with more
hubs from round to round, as long as that links them; members that then belong together need no comparison among each other.  The rest meet pair by
pair over lists of larger sketches, mostly whole sets, whose exact overlap bounds leave out documents that only share a
passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rategrid.llm.components import components
from rategrid.llm.hashing import Words, chunks, give_back, word_hashes
from rategrid.llm.storage import stage
from rategrid.llm.text import digest, let

SHINGLE = 5
SKETCH = 64
LARGE = 1024  # retained values where few-value sketches leave a pair open
LEAST_YIELD = 8  # rounds with one hub, and with many, go on while one of so many pairs links
BREADTHS = (4, 16, 64, 256)  # hubs that a node meets in each of the next rounds; those still apart then meet all
FEW = 16  # up to so many hubs a round is held whatever the one before linked
DEVIATIONS = 4.0  # a pair at the threshold shares fewer values than allowed for with probability 3e-5


def shingle_sets(words: Words, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle values (63 bits) of each document; a short document is one shingle, an empty one none."""
    grams = words.windows(size)
    for lo, hi in zip(words.first[:-1], words.first[1:], strict=True):
        if hi - lo >= size:
            found = np.unique(grams[lo : hi - size + 1] >> np.uint64(1))
        elif hi > lo:
            found = words.spans(np.array([lo]), np.array([hi])) >> np.uint64(1)
        else:
            found = np.zeros(0, dtype=np.uint64)
        yield found.view(np.int64)


def _sketches(size: int, k: int):
    numbers = [(c, pa.int64()) for c in ("row", "doc_id", "m1", "m2")]
    schema = pa.schema([*numbers, ("text", pa.string()), *[(c, pa.int64()) for c in ("n", "s1", "s2")], ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, to, data, offsets in chunks(batch.column(3)):
                counts, names, kept = [], [], []
                for values in shingle_sets(word_hashes(data, offsets, lower=True), size):
                    counts.append(len(values))
                    names.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                    kept.append(values[:k])
                name = np.frombuffer(b"".join(names), dtype=np.int64).reshape(-1, 2)
                places = np.concatenate([[0], np.cumsum([len(v) for v in kept])]).astype(np.int32)
                sketch = pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate(kept)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + to - at)),
                        batch.column(0).slice(at, to - at).cast(pa.int64()),
                        batch.column(1).slice(at, to - at),
                        batch.column(2).slice(at, to - at),
                        batch.column(3).slice(at, to - at).cast(pa.string()),
                        pa.array(counts, pa.int64()),
                        pa.array(name[:, 0].copy()),
                        pa.array(name[:, 1].copy()),
                        sketch,
                    ],
                    schema=schema,
                )
                row += to - at
        give_back()

    return run


def _full_sets(size: int):
    schema = pa.schema([("node", pa.int64()), ("values", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in chunks(batch.column(1)):
                kept = list(shingle_sets(word_hashes(data, offsets, lower=True), size))
                places = np.concatenate([[0], np.cumsum([len(v) for v in kept])]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate(kept)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), values], schema=schema)
        give_back()

    return run


def least_overlap(n: Column, percent: int, k: int) -> Column:
    """Values that the sketches of a linked pair share at least, for a set of ``n`` values.

    If the union fits the sketch this is exact: ``percent`` of it.  Else the k smallest of the union are a random draw
    without replacement, whose count of shared values stays within ``DEVIATIONS`` of its mean.
    """
    t = percent / 100.0
    union = F.greatest(F.ceil(n / t), F.lit(k)).cast("double")
    spread = F.sqrt(F.greatest((union - k) / F.greatest(union - 1, F.lit(1.0)), F.lit(0.0)) * (k * t * (1 - t)))
    drawn = F.floor(F.lit(k * t) - spread * DEVIATIONS)
    return F.greatest(F.least(F.ceil(n * t), drawn), F.lit(1)).cast("int")


def pair_overlap(n: Column, m: Column, percent: int, k: int) -> Column:
    """Like :func:`least_overlap` for two sets: exact where both are kept whole, which both sizes then decide."""
    whole = F.ceil((n + m) * percent / (100 + percent)).cast("int")
    return F.when(F.greatest(n, m) <= k, whole).otherwise(least_overlap(F.greatest(n, m), percent, k))


def any_overlap(n: Column, percent: int, k: int) -> Column:
    """The least :func:`pair_overlap` of a set of ``n`` values with any linked partner that is not smaller.

    It grows with the partner's size as long as the partner is kept whole and falls from there on, so it is least at the
    smallest or the largest partner.
    """
    largest = F.floor(n * 100 / percent)
    return F.least(pair_overlap(n, n, percent, k), pair_overlap(n, largest, percent, k))


def inverted_lists(classes: DataFrame, percent: int, k: int) -> DataFrame:
    """``v, node, n, band, rank, weight``: the rarest retained values of each class that another class retains too.

    ``rank`` counts from 1 over all retained values, rarest first; ``weight`` is how often the class's values occur.
    """
    rows = classes.select("node", "n", F.explode("sketch").alias("v"))
    # written first: with a shuffle on both sides of the join a hot value's partition can be split
    shared = stage(rows.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "neardup-values")
    own = rows.join(shared, "v").groupBy("node").agg(
        F.first("n").alias("n"), F.sum("df").alias("weight"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("values")
    )
    held = F.least(F.col("n"), F.lit(k)).cast("int")
    rare = held - F.size("values")  # values that no other class has come first
    room = held - least_overlap(F.col("n"), percent, k) + 1 - rare
    kept = own.filter(room > 0).select("node", "n", "weight", rare.alias("rare"), F.posexplode(F.slice("values", 1, room)).alias("at", "x"))
    # sets of linked documents differ in size by less than 100 / percent: the same or the next band
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100.0 / percent))).cast("int")
    rank = F.col("rare") + F.col("at") + 1
    return kept.select(F.col("x.v").alias("v"), "node", "n", band.alias("band"), rank.alias("rank"), "weight")


def _passes(a: Column, b: Column, n: Column, m: Column, percent: int, k: int) -> Column:
    """Overlap inside the sketch of the union, null where it is too small."""

    def overlap(union: Column) -> Column:
        most = F.element_at(F.slice(union, 1, k), -1)
        return F.size(F.filter(F.array_intersect(a, b), lambda v: v <= most))

    return let(F.sort_array(F.array_union(a, b)), overlap) >= least_overlap(F.greatest(n, m), percent, k)


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """Links ``a, b`` among ``pairs``."""
    sketch = classes.select("node", "n", "sketch")
    left = sketch.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = sketch.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    near = pairs.join(right, "b").join(left, "a")
    sized = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    near = near.filter(sized & _passes(F.col("s_a"), F.col("s_b"), F.col("n_a"), F.col("n_b"), percent, k))
    near = near.select("a", "b")
    full = near.join(sets.select(F.col("node").alias("b"), F.col("values").alias("v_b")), "b")
    full = full.join(sets.select(F.col("node").alias("a"), F.col("values").alias("v_a")), "a")
    both = full.select("a", "b", F.size("v_a").alias("x"), F.size("v_b").alias("y"), F.size(F.array_intersect("v_a", "v_b")).alias("i"))
    return both.filter((F.col("i") * 100 >= percent * (F.col("x") + F.col("y") - F.col("i")))).select("a", "b")


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after joining components through new links."""
    a = labels.select(F.col("node").alias("a"), F.col("comp").alias("c_a"))
    b = labels.select(F.col("node").alias("b"), F.col("comp").alias("c_b"))
    joined = links.join(a, "a").join(b, "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).filter("a <> b")
    joined = stage(joined.distinct(), "neardup-joins")
    if joined.isEmpty():
        return labels
    merged = components(joined).select(F.col("node").alias("comp"), F.col("comp").alias("into"))
    return stage(labels.join(merged, "comp", "left").select("node", F.coalesce("into", "comp").alias("comp")), "neardup-labels")


def _main(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent component of each list (``main``) where it has several."""
    sizes = rows.groupBy(*keys, "comp").agg(F.count(F.lit(1)).alias("m"))
    main = sizes.groupBy(*keys).agg(F.max(F.struct("m", "comp")).alias("x"), F.count(F.lit(1)).alias("kinds"))
    return main.filter("kinds > 1").select(*keys, F.col("x.comp").alias("main"))


def _possible(percent: int, k: int) -> Column:
    """Can sets a and b that share a value of ranks ``rank_a`` and ``rank_b`` be linked, by sizes and ranks?

    Linked sets share at least :func:`pair_overlap` values, so their rarest shared value stands early in both.
    """
    n, m = F.col("n_a"), F.col("n_b")
    sized = (n * 100 >= m * percent) & (m * 100 >= n * percent)
    least = pair_overlap(n, m, percent, k)
    early = [F.col(f"rank_{x}") <= F.least(F.col(f"n_{x}"), F.lit(k)) - least + 1 for x in "ab"]
    return sized & early[0] & early[1] & (F.col("comp_a") != F.col("comp_b"))


def _sided(rows: DataFrame, keys: list[str], side: str) -> DataFrame:
    return rows.select(*keys, *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "rank", "comp")])


def _top(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key; the engine takes them before the shuffle as well."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def _hub_pairs(lists: DataFrame, labels: DataFrame, tried: DataFrame | None, percent: int, k: int, breadth: int) -> DataFrame:
    """Each node beside ``breadth`` hubs at most, if they are still apart and can be linked.

    Hubs of a list are the members whose values are the most frequent: the origin of many copies, rather than one of
    them.  Of the hubs of all its lists a node meets those that are hubs in most of them, and none twice.  After the
    first round only members outside the largest component of a list look for one.
    """
    named = lists.join(labels, "node")
    looking = named
    if tried is not None:
        split = stage(named.join(_main(named, ["v", "band"]), ["v", "band"]), "neardup-split")
        named, looking = split.drop("main"), split.filter("comp <> main").drop("main")
    hubs = _top(named, ["v", "band"], [F.desc("weight"), F.xxhash64("node"), F.col("node")], breadth)
    hubs = stage(_sided(hubs, ["v", "band"], "b"), "neardup-hubs")
    met = _sided(looking, ["v", "band"], "a").join(hubs, ["v", "band"]).filter(_possible(percent, k))
    met = met.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(F.count(F.lit(1)).alias("lists"))
    if tried is not None:
        met = met.join(tried, ["a", "b"], "left_anti")
    nearest = _top(met, ["a"], [F.desc("lists"), F.xxhash64("b"), F.col("b")], breadth)
    return stage(nearest.select("a", "b"), "neardup-met")


def _open_pairs(lists: DataFrame, labels: DataFrame, percent: int, k: int) -> DataFrame:
    """All pairs ``a, b`` of a list in different components that can be linked.

    For the smaller set the rank of a shared value is low whatever its partner's size (``brief``), which leaves few
    members in the list of a frequent value.
    """
    named = lists.join(labels, "node")
    spread = named.withColumn("block", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    split = stage(spread.join(_main(spread, ["v", "block"]), ["v", "block"]), "neardup-open")
    held = F.least(F.col("n"), F.lit(k)).cast("int")
    brief = split.filter(F.col("rank") <= held - any_overlap(F.col("n"), percent, k) + 1)
    keys = ["v", "block"]
    # the smaller set stands on the left; of equal ones the smaller number
    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
    apart = ordered & _possible(percent, k)
    outside = F.col("comp") != F.col("main")
    left = _sided(brief.filter(outside), keys, "a").join(_sided(split, keys, "b"), keys).filter(apart)
    right = _sided(brief.filter(~outside), keys, "a").join(_sided(split.filter(outside), keys, "b"), keys).filter(apart)
    both = left.select("node_a", "node_b").unionByName(right.select("node_a", "node_b"))
    return both.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def linked_classes(classes: DataFrame, sets_of, percent: int, k: int) -> DataFrame:
    """``node, comp`` of every class that shares an indexed value with another."""
    lists = stage(inverted_lists(classes, percent, k), "neardup-lists")
    labels = stage(lists.select("node").distinct().withColumn("comp", F.col("node")), "neardup-labels")
    sets = sets_of(labels.select("node"))
    tried = None
    met = linked = 1
    while linked * LEAST_YIELD >= met:  # one hub for each node and round
        pairs = _hub_pairs(lists, labels, tried, percent, k, 1)
        links = stage(_verified(pairs, classes, sets, percent, k), "neardup-links")
        met, linked = pairs.count(), links.count()
        labels = _relabel(labels, links)
        tried = pairs if tried is None else tried.unionByName(pairs)
        if not met:
            break
    # what is still apart goes on over lists of larger sketches, nearly all of them whole sets, with more hubs each time
    named = lists.join(labels, "node").withColumn("block", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    open_nodes = named.join(_main(named, ["v", "block"]), ["v", "block"]).select("node").distinct()
    large = sets.join(open_nodes, "node", "left_semi")
    large = large.select("node", F.size("values").cast("long").alias("n"), F.slice("values", 1, LARGE).alias("sketch"))
    longer = stage(inverted_lists(large, percent, LARGE), "neardup-lists")
    for breadth in BREADTHS:
        # members of lists that link with few hubs gain nothing from many: a list shorter than that would be met in all
        # its pairs, twice, where the last step meets those of the smaller set's early values only
        if breadth > FEW and linked * LEAST_YIELD < met:
            break
        pairs = _hub_pairs(longer, labels, tried, percent, LARGE, breadth)
        links = stage(_verified(pairs, classes, sets, percent, k), "neardup-links")
        met, linked = pairs.count(), links.count()
        if not met:
            break
        labels = _relabel(labels, links)
        tried = tried.unionByName(pairs)
    # and at last pair by pair, whatever their number
    pairs = stage(_open_pairs(longer, labels, percent, LARGE).join(tried, ["a", "b"], "left_anti"), "neardup-pairs")
    return _relabel(labels, _verified(pairs, classes, sets, percent, k))


def marked_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75, shingle: int = SHINGLE, k: int = SKETCH
) -> DataFrame:
    """:func:`near_duplicates` with ``m1, m2``, the digest of the text, which tells rows of one id or of none apart."""
    m1, m2 = digest(F.col(text))
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), m1.alias("m1"), m2.alias("m2"), F.col(text).alias("text"))
    columns = "row long, doc_id long, m1 long, m2 long, text string, n long, s1 long, s2 long, sketch array<long>"
    rows = stage(base.mapInArrow(_sketches(shingle, k), columns), "neardup-sketches")
    # equal sets are one class; partial aggregation meets copies before the shuffle
    first = [F.first(c).alias(c) for c in ("n", "sketch")]
    one = [F.min("row").alias("row"), F.min(F.struct("doc_id", "m1", "m2")).alias("of")]
    grouped = rows.filter("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("least_id"), *first, *one)
    classes = stage(grouped, "neardup-classes").withColumn("node", F.col("row"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        """One set for each node, whose number is that of one of its rows."""
        texts = rows.select(F.col("row").alias("node"), "text").join(nodes, "node", "left_semi")
        return stage(texts.mapInArrow(_full_sets(shingle), "node long, values array<long>"), "neardup-sets")

    labels = linked_classes(classes, sets_of, percent, k)
    named = classes.select("s1", "s2", "node", "least_id", "of").join(labels, "node", "left")
    named = named.withColumn("comp", F.coalesce("comp", "node"))
    # where no member has an id, the one with the least digest is kept
    keeper = F.min(F.struct("of.m1", "of.m2")).alias("keeper")
    least = named.groupBy("comp").agg(F.min("least_id").alias("component_id"), keeper)
    of_class = named.join(least, "comp").select("s1", "s2", "component_id", "keeper")
    found = rows.select("doc_id", "m1", "m2", F.col("n").alias("n_shingles"), "s1", "s2").join(of_class, ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = found.select("doc_id", "m1", "m2", "n_shingles", component.alias("component_id"), "keeper")
    chosen = (F.col("m1") == F.col("keeper.m1")) & (F.col("m2") == F.col("keeper.m2"))
    nameless = F.col("component_id").isNull() & (F.col("n_shingles") > 0)
    kept = F.when(nameless, chosen).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.withColumn("kept", kept).drop("keeper")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75, shingle: int = SHINGLE, k: int = SKETCH
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every input row.

    Words are lower-cased (A-Z); documents whose shingle sets reach ``percent`` similarity are linked; ``component_id`` is
    the smallest id reachable.  Documents without words link with nothing.  Repeated rows link with each other.  A
    null id stays null unless its document is linked to one with an id; of a group without any id one text is kept.
    """
    return marked_duplicates(docs, doc_id, text, percent, shingle, k).select("doc_id", "n_shingles", "component_id", "kept")
