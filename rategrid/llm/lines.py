"""Line dedup: lines that many documents share stay in one of them only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rategrid.llm.storage import stage
from rategrid.llm.text import BLANK_CHARS, ascii_lower, let, lines, whole


def line_key(line: Column) -> Column:
    """The line without surrounding white space, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANK_CHARS)))


def _keyed(text: str, min_chars: int) -> Column:
    """One struct per line that may be dropped: position, two hashes of its key."""
    found = F.transform(
        lines(whole(text)),
        lambda line, i: F.struct(i.alias("pos"), line_key(line).alias("key")),
    )
    long = F.filter(found, lambda x: F.char_length(x["key"]) >= min_chars)
    return F.transform(
        long,
        lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(7), x["key"]).alias("h2")),
    )


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Drop lines whose key (``min_chars`` code points or more) is in ``min_docs`` documents or more.

    Such lines stay in the largest id that holds them.  Returns per input row: ``doc_id, text`` (the kept lines joined),
    ``n_lines, n_dropped``.  A null or empty text is one empty line.  Rows with one id are one document; a row without
    an id belongs to a document without an id, which counts as none and never is the largest.  Repeated rows all return.
    Columns named in ``keep`` pass through.

    Lines are exploded as hashes, counted with partial aggregation on both levels (so a line of every document is no
    hot key), and the positions of dropped lines return as one list per row, taken out by a hash set.
    """
    # rows with one id may differ in their texts: positions belong to the id and the text
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_mark"), *keep)
    exploded = base.select("doc_id", "_mark", F.explode(_keyed("text", min_chars)).alias("l")).select(
        "doc_id", "_mark", "l.pos", "l.h1", "l.h2"
    )
    # one row per line and document first: a repeated line inside a document counts once
    once = exploded.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    # written first, so that the join below has two shuffles and a hot line's partition can be split
    shared = stage(
        once.groupBy("h1", "h2")
        .agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper"),
        "shared-lines",
    )
    gone = (
        exploded.join(shared, ["h1", "h2"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("gone_id"), F.col("_mark").alias("gone_mark"))
        .agg(F.collect_set("pos").alias("gone"))
    )
    both = base.join(gone, base["doc_id"].eqNullSafe(gone["gone_id"]) & (base["_mark"] == gone["gone_mark"]), "left")
    all_lines = lines(whole("text"))

    def reassembled(found: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(found) - 1), F.col("gone"))
        return F.transform(stay, lambda at: F.get(found, at))

    kept = F.when(F.col("gone").isNull(), all_lines).otherwise(let(all_lines, reassembled))
    split = both.select("doc_id", *keep, F.size(all_lines).cast("long").alias("n_lines"), kept.alias("kept"))
    return split.select(
        "doc_id",
        *keep,
        F.array_join("kept", "\n").alias("text"),
        "n_lines",
        (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"),
    )
