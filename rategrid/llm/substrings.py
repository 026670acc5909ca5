"""Substring dedup by seed and extend: winnowed anchors find repeated passages, equal surroundings extend them.

Every window of ``length`` words is assigned to its smallest k-gram (the leftmost of equal ones), its anchor.  Equal
windows have equal anchors at equal offsets, so a window can only repeat where its anchor does.  The windows of one
anchor place form one span of text, which reaches to both sides of the anchor:

* a span that occurs twice or more is a repeat as a whole, for all its places at once;
* where an anchor has several different spans, extension goes window by window, over one place of each span.

Copies therefore cost one row per anchor, never a pair per copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rategrid.llm.hashing import Words, chunks, word_hashes
from rategrid.llm.storage import stage
from rategrid.llm.text import digest

GRAM = 10
_BITS = 24
_BLOCK = 1 << 22


def anchors_of(words: Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first and last window start, anchor hash and span hash."""
    starts = words.valid_starts(length)
    none = np.zeros(0, dtype=np.int64)
    if not len(starts):
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams = words.windows(gram)
    reach = length - gram + 1
    place = np.empty(len(starts), dtype=np.int64)
    low = np.uint64((1 << _BITS) - 1)
    for a in range(0, len(starts), _BLOCK):
        part = starts[a : a + _BLOCK]
        base = part[0]
        view = grams[base : part[-1] + reach]
        # bounded blocks keep positions within _BITS, so one minimum gives the hash and the leftmost place
        least = (view & ~low) | np.arange(len(view), dtype=np.uint64)
        done = 1
        while done < reach:
            by = min(done, reach - done)
            least = np.minimum(least[:-by], least[by:])
            done += by
        place[a : a + _BLOCK] = (least[part - base] & low).astype(np.int64) + base
    new = np.empty(len(starts), dtype=bool)
    new[0] = True
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts)) - 1
    lo, hi, at = starts[head], starts[tail], place[head]
    shape = (at - lo).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    return lo, hi, grams[at], words.spans(lo, hi + length) ^ shape


def _seeds(length: int, gram: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("m1", pa.int64()), ("m2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("h", pa.int64()), ("s", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, m1, m2 = batch.column(0), batch.column(1), batch.column(2)
            for at, to, data, offsets in chunks(batch.column(3)):
                words = word_hashes(data, offsets)
                lo, hi, h, s = anchors_of(words, length, gram)
                doc = np.searchsorted(words.first, lo, side="right") - 1
                rows = pa.array(doc + at)
                base = words.first[doc]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(rows).cast(pa.int64()),
                        m1.take(rows),
                        m2.take(rows),
                        pa.array((lo - base).astype(np.int32)),
                        pa.array((hi - base).astype(np.int32)),
                        pa.array(h.view(np.int64)),
                        pa.array(s.view(np.int64)),
                    ],
                    schema=schema,
                )

    return run


def _windows(length: int):
    """Window hashes of the wanted spans of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("m1", pa.int64()), ("m2", pa.int64()), ("h", pa.int64()), ("w", pa.int64()), ("at", pa.int32()), ("single", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, m1, m2 = batch.column(0), batch.column(1), batch.column(2)
            lists = batch.column(4)
            for at, to, data, offsets in chunks(batch.column(3)):
                words = word_hashes(data, offsets)
                windows = words.windows(length, base=0xC2B2AE3D27D4EB4F)
                part = lists.slice(at, to - at)
                sizes = np.asarray(part.value_lengths().fill_null(0))
                flat = part.flatten()
                lo = np.asarray(flat.field("lo")).astype(np.int64)
                count = np.asarray(flat.field("hi")).astype(np.int64) - lo + 1
                doc = np.repeat(np.arange(to - at), sizes)
                span = np.repeat(np.arange(len(lo)), count)
                inside = np.arange(len(span)) - np.repeat(np.cumsum(count) - count, count)
                start = lo[span] + inside
                rows = pa.array(doc[span] + at)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(rows).cast(pa.int64()),
                        m1.take(rows),
                        m2.take(rows),
                        flat.field("h").take(pa.array(span)),
                        pa.array(windows[words.first[doc[span]] + start].view(np.int64)),
                        pa.array(start.astype(np.int32)),
                        flat.field("single").take(pa.array(span)),
                    ],
                    schema=schema,
                )

    return run


def _cut(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(1), batch.column(2)
            for at in range(0, batch.num_rows, 512):
                out_words, out_gone, out_text = [], [], []
                for text, spans in zip(texts.slice(at, 512), lists.slice(at, 512), strict=True):
                    body = (text.as_py() or "").encode().split()  # ASCII white space only
                    n = len(body)
                    ranges = spans.as_py() if spans.is_valid else None
                    gone = 0
                    if ranges:
                        edge = np.zeros(n + 1, dtype=np.int64)
                        np.add.at(edge, [r["lo"] for r in ranges], 1)
                        np.add.at(edge, [r["hi"] + length for r in ranges], -1)
                        keep = np.cumsum(edge[:n]) == 0
                        gone = n - int(keep.sum())
                        body = [body[i] for i in np.flatnonzero(keep)]
                    out_words.append(n)
                    out_gone.append(gone)
                    out_text.append(b" ".join(body).decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 512).cast(pa.int64()), pa.array(out_words, pa.int64()), pa.array(out_gone, pa.int64()), pa.array(out_text, pa.string())],
                    schema=schema,
                )

    return run


def repeated_spans(base: DataFrame, length: int, gram: int) -> DataFrame:
    """Window starts lo to hi that begin a repeat: ``doc_id, m1, m2, lo, hi``.  ``base`` has ``doc_id, m1, m2, text``."""
    seeds = base.mapInArrow(_seeds(length, gram), "doc_id long, m1 long, m2 long, lo int, hi int, h long, s long")
    seeds = stage(seeds, "repeat-seeds")
    # anchors that occur once are gone after this; what is left is proportional to the repeated text.  Counts that rows
    # are joined with are written first: with a shuffle on both sides a hot anchor's partition can be split.
    twice = stage(seeds.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "repeat-anchors")
    met = stage(seeds.join(twice, "h", "left_semi"), "repeat-met")
    kinds = met.groupBy("h", "s").agg(
        F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "m1", "m2", "lo", "hi")]
    )
    kinds = stage(kinds, "repeat-kinds")
    whole_spans = met.join(kinds.filter("n > 1").select("h", "s"), ["h", "s"], "left_semi").select("doc_id", "m1", "m2", "lo", "hi")
    mixed_anchors = stage(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("h"), "repeat-mixed")
    open_spans = (
        kinds.join(mixed_anchors, "h", "left_semi")
        .withColumn("single", F.col("n") == 1)
        .groupBy("doc_id", "m1", "m2")
        .agg(F.collect_list(F.struct("h", "lo", "hi", "single")).alias("spans"))
        .select(F.col("doc_id").alias("o_id"), F.col("m1").alias("o_m1"), F.col("m2").alias("o_m2"), "spans")
    )
    on = base["doc_id"].eqNullSafe(open_spans["o_id"]) & (base["m1"] == open_spans["o_m1"]) & (base["m2"] == open_spans["o_m2"])
    looked = base.join(open_spans, on).select("doc_id", "m1", "m2", "text", "spans")
    windows = looked.mapInArrow(_windows(length), "doc_id long, m1 long, m2 long, h long, w long, at int, single boolean")
    windows = stage(windows, "repeat-windows")
    shared = stage(windows.groupBy("h", "w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "w"), "repeat-shared")
    partial = (
        windows.filter("single").join(shared, ["h", "w"], "left_semi").select("doc_id", "m1", "m2", F.col("at").alias("lo"), F.col("at").alias("hi"))
    )
    return whole_spans.unionByName(partial)


def dedup_substrings(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 35, gram: int = GRAM
) -> DataFrame:
    """Remove every word inside a window of ``length`` words whose sequence also starts elsewhere.

    Returns per input row ``doc_id, n_words, n_removed, text`` (the kept words joined by one space).  Null text has no
    words.  Places are (row, position): a repeated row is another place, so both lose their windows.  Windows are judged
    on the input; documents shorter than ``length`` words keep everything; null ids keep their rows.
    """
    m1, m2 = digest(F.col(text))  # tells rows of one id or of none apart
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), m1.alias("m1"), m2.alias("m2"), F.col(text).alias("text"))
    spans = (
        repeated_spans(base, length, gram)
        .groupBy("doc_id", "m1", "m2")
        .agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
        .select(F.col("doc_id").alias("s_id"), F.col("m1").alias("s_m1"), F.col("m2").alias("s_m2"), "spans")
    )
    on = base["doc_id"].eqNullSafe(spans["s_id"]) & (base["m1"] == spans["s_m1"]) & (base["m2"] == spans["s_m2"])
    joined = base.join(spans, on, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut(length), "doc_id long, n_words long, n_removed long, text string")
