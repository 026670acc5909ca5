"""Token counts by a two-tier lookup of pre-tokens.

A byte-level tokenizer cuts a text into pre-tokens and merges inside each of them only, so the tokens of a text are the
sum over its pre-tokens.  The first tier is a compact hash table of frequent pre-tokens with their lengths in tokens,
broadcast once; what it misses goes through a cache in each Python worker and reaches the tokenizer only when it is new
there.  Nothing but the table's sample leaves a task: pre-tokens are never shuffled.

The cut is made for many texts at once over arrays of characters; the class of a character (letter, digit, blank or
other) is asked of the tokenizer itself when the character first appears.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rategrid.llm.hashing import chunks, mixed

SAMPLE_DOCS = 2048  # rows drawn (on average) to choose the table's entries; no count depends on them
TABLE_BITS = 18  # slots of the table; a quarter of them is filled
CACHE = 200_000  # pre-tokens in a generation of a worker's cache
KEY_BYTES = 15  # longer pre-tokens skip the table
CACHE_BYTES = 256  # and longer ones than this the cache
LETTER, DIGIT, BLANK, OTHER, UNKNOWN = range(5)
#: Fixed values of the tokenizer's pattern: letters that an apostrophe takes along.
TAKEN_ONE, TAKEN_TWO = "stmd", ("re", "ve", "ll")


class Counter2:
    """Counts in two generations: what is asked for again moves on when the older one is dropped."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def get(self, piece: bytes) -> int | None:
        if (found := self.young.get(piece)) is None and (found := self.old.get(piece)) is not None:
            self.young[piece] = found
        return found

    def add(self, piece: bytes, count: int) -> None:
        if len(piece) <= CACHE_BYTES:
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[piece] = count


class PreTokens:
    """The tokenizer's cut into pre-tokens, for many texts in a row."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        added = self.tokenizer.get_added_tokens_decoder().values()
        if self.tokenizer.normalizer is not None or [p for p, _ in self.cut("a'sa b")] != ["a", "'s", "a", "Ġb"]:
            raise ValueError(f"{path} is not a plain byte-level tokenizer")
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError(f"{path} has added tokens that take their surroundings along")
        self.specials = sorted((t.content for t in added), key=len, reverse=True)
        self.kinds = np.full(0x110000, UNKNOWN, dtype=np.uint8)
        self.cache = Counter2(CACHE)

    def _kind(self, character: str) -> int:
        """A run of one class is one pre-token."""
        for kind, beside in ((LETTER, "a"), (DIGIT, "1"), (OTHER, "!")):
            if len(self.cut(beside + character + beside)) == 1:
                return kind
        return BLANK

    def kinds_of(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kinds[points]
        if (open_points := points[kinds == UNKNOWN]).size:
            for point in np.unique(open_points).tolist():
                self.kinds[point] = self._kind(chr(point))
            kinds = self.kinds[points]
        return kinds

    def starts(self, points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        """Flags of the characters that begin a pre-token; ``breaks`` flags the first character of each text."""
        n = len(points)
        kinds = self.kinds_of(points)
        start = breaks.copy()
        start[1:] |= kinds[1:] != kinds[:-1]
        blank = kinds == BLANK
        # the last blank before something else stands alone, or goes with it where it is a space
        last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~breaks[1:])
        start[last] = True
        start[last[points[last] == 32] + 1] = False
        # an apostrophe that begins a pre-token takes some endings along
        marks = np.flatnonzero((points == 39) & start)
        tail = np.concatenate([points, np.zeros(3, dtype=points.dtype)])
        ends = np.concatenate([breaks, np.ones(3, dtype=bool)])
        one = marks[np.isin(tail[marks + 1], [ord(c) for c in TAKEN_ONE]) & ~ends[marks + 1]]
        two = [marks[(tail[marks + 1] == ord(t[0])) & (tail[marks + 2] == ord(t[1])) & ~ends[marks + 1] & ~ends[marks + 2]] for t in TAKEN_TWO]
        for width, found in ((1, one), *((2, t) for t in two)):
            start[found + 1] = False
            after = found + 1 + width
            start[after[after < n]] = True
        return start

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte of each pre-token, and the first pre-token of each text (with the number of all at the end)."""
        if not len(data):
            return np.zeros(0, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
        breaks = np.zeros(len(data) + 1, dtype=bool)
        breaks[offsets] = True
        if data.max() < 128:
            begins = np.flatnonzero(self.starts(data, breaks[:-1]))
        else:
            leads = np.flatnonzero((data & 0xC0) != 0x80)
            points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
            begins = leads[self.starts(points, breaks[leads])]
        return begins, np.searchsorted(begins, offsets)

    def tokens(self, pieces: list[bytes]) -> list[int]:
        """Numbers of tokens of single pre-tokens, by the tokenizer."""
        found = self.tokenizer.encode_batch_fast([p.decode("utf-8") for p in pieces], add_special_tokens=False)
        return [len(f.ids) for f in found]

    def looked_up(self, body: bytes, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Numbers of tokens of the pre-tokens that the table misses."""
        get = self.cache.get
        pieces = [body[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        counts = [get(p) for p in pieces]
        new = list({p for p, c in zip(pieces, counts, strict=True) if c is None})
        if new:
            known = dict(zip(new, self.tokens(new), strict=True))
            counts = [known[p] if c is None else c for p, c in zip(pieces, counts, strict=True)]
            for piece, count in known.items():
                self.cache.add(piece, count)
        return np.array(counts, dtype=np.int64)


@lru_cache(maxsize=2)
def pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)


def keys(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens of at most ``KEY_BYTES`` bytes as two words: the bytes themselves and the length, so no two are equal."""
    padded = np.zeros(len(data) + 16, dtype=np.uint8)
    padded[: len(data)] = data
    words = np.ndarray(len(data) + 9, dtype="<u8", buffer=padded, strides=(1,))
    sizes = hi - lo
    masks = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
    first = words[lo] & masks[np.minimum(sizes, 8)]
    second = words[lo + 8] & masks[np.clip(sizes - 8, 0, 8)] if len(lo) else np.zeros(0, dtype=np.uint64)
    return first, second | (sizes.astype(np.uint64) << np.uint64(56))


class LengthTable:
    """Hash table in flat arrays: a key stands in its slot or in one of the next ones."""

    def __init__(self, pieces: list[bytes], tokens: list[int], bits: int = TABLE_BITS) -> None:
        self.mask = (1 << bits) - 1
        self.first = np.zeros(1 << bits, dtype=np.uint64)
        self.second = np.zeros(1 << bits, dtype=np.uint64)  # 0 marks a free slot: a length is never 0
        self.tokens = np.zeros(1 << bits, dtype=np.uint8)
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)
        starts = np.concatenate([np.zeros(1, dtype=np.int64), ends[:-1]])[: len(ends)]
        first, second = keys(data, starts, ends)
        for a, b, count, slot in zip(first.tolist(), second.tolist(), tokens, self._slots(first, second).tolist(), strict=True):
            while self.second[slot]:
                slot = (slot + 1) & self.mask
            self.first[slot], self.second[slot], self.tokens[slot] = a, b, count

    def _slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return (mixed(first ^ (second * np.uint64(0x9E3779B97F4A7C15))) & np.uint64(self.mask)).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Tokens of each key, 0 where the table lacks it."""
        out = np.zeros(len(first), dtype=np.int64)
        left, slot = np.arange(len(first)), self._slots(first, second)
        while left.size:
            there = self.second[slot]
            hit = (there == second[left]) & (self.first[slot] == first[left])
            out[left[hit]] = self.tokens[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) & self.mask
        return out


def _parts(texts: pa.Array, specials: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Texts cut at the strings of special tokens, and the first part of each (with the number of parts at the end)."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    texts = texts.fill_null("")
    if not specials:
        return texts, np.arange(len(texts) + 1)
    if len(specials) == 1:
        made = pc.split_pattern(texts, specials[0])
    else:
        made = pc.split_pattern_regex(texts, "|".join("\\Q" + s + "\\E" for s in specials))
    places = made.offsets.to_numpy()
    return made.flatten(), places - places[0]


def _frequent(path: str):
    schema = pa.schema([("piece", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, seen = pre_tokens(path), Counter()
        for batch in batches:
            parts, _ = _parts(batch.column(0), tool.specials)
            for _, _, data, offsets in chunks(parts):
                begins, _ = tool.pieces(data, offsets)
                ends = np.append(begins[1:], len(data))
                short, body = ends - begins <= KEY_BYTES, data.tobytes()
                seen.update(body[a:b] for a, b in zip(begins[short].tolist(), ends[short].tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], schema=schema)

    return run


def length_table(docs: DataFrame, path: str, text: str = "text", sample: int = SAMPLE_DOCS, bits: int = TABLE_BITS) -> LengthTable:
    """Table of the most frequent pre-tokens of about ``sample`` rows drawn from all over ``docs``.

    The draw bounds what reaches the driver whatever the size of ``docs``.
    """
    rows = docs.count()
    drawn = docs.select(text).sample(min(1.0, sample / rows), seed=12) if rows else docs.select(text)
    seen: Counter = Counter()
    for row in drawn.mapInArrow(_frequent(path), "piece binary, n long").toLocalIterator():
        seen[bytes(row["piece"])] += row["n"]
    chosen = [p for p, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: 1 << (bits - 2)]]
    return LengthTable(chosen, pre_tokens(path).tokens(chosen) if chosen else [], bits)


def _counting(path: str, table):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, known = pre_tokens(path), table.value
        for batch in batches:
            texts = batch.column(1).fill_null("")
            parts, first = _parts(texts, tool.specials)
            of_part = np.zeros(len(parts) + 1, dtype=np.int64)
            for at, to, data, offsets in chunks(parts):
                begins, piece = tool.pieces(data, offsets)
                ends = np.append(begins[1:], len(data))[: len(begins)]
                counts = np.zeros(len(begins), dtype=np.int64)
                short = np.flatnonzero(ends - begins <= KEY_BYTES)
                counts[short] = known.find(*keys(data, begins[short], ends[short]))
                missed = np.flatnonzero(counts == 0)
                if missed.size:
                    counts[missed] = tool.looked_up(data.tobytes(), begins[missed], ends[missed])
                sums = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(counts)])
                of_part[at + 1 : to + 1] = sums[piece[1:]] - sums[piece[:-1]]
            sums = np.cumsum(of_part)
            tokens = sums[first[1:]] - sums[first[:-1]] + np.diff(first) - 1  # each cut is a special token
            sizes = pc.cast(pc.binary_length(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), sizes, pa.array(tokens, pa.int64())], schema=schema)

    return run


def count_tokens(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str | Column = "text", limit: int = 1024, sample: int = SAMPLE_DOCS
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``path`` is the file of a byte-level BPE tokenizer that every executor can read; strings of its special tokens inside
    a text are special tokens, none are added.  Null and empty texts have no bytes and no tokens; texts of any length
    are counted whole; repeated rows come as often as they stand in ``docs``; an empty table gives no row; a null
    ``doc_id`` stays null.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.col(text) if isinstance(text, str) else text).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(length_table(rows, path, "text", sample))
    counted = rows.mapInArrow(_counting(path, table), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
