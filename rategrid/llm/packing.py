"""Lexical retrieval packing: documents that share rare words fill windows together.

Documents are encoded once and written.  Corpus-wide document counts of token ids (at most one row per id of the
vocabulary) give BM25 its weights.  Each partition of the written table is worked through in shards: a shard has its
own inverted index, a seed document asks it for unused neighbours, and these fill the seed's window, whole ones that
fit first, else the best one is cut.  What is cut off opens the next window, so nothing is padded but the last window
of a partition.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rategrid.llm.hashing import chunks, give_back
from rategrid.llm.storage import stage

WINDOW = 2048
SHARD_DOCS = 2048
SHARD_TOKENS = 1 << 22
FREQUENT = 8  # a term in one of so many documents of a shard is frequent there
SHRINK = 0.8  # share of unused documents below which an index drops the postings of the others
K1, B = 1.2, 0.75
CACHE = 300_000  # encoded runs of a generation in each Python worker
CHUNK = 1 << 21  # bytes whose runs are told apart together
LOW = 0x300  # below it no character joins its neighbour when a text is normalised
WORD_END = "</w>"
LETTER, DIGIT, SIGN, BLANK, ODD = range(5)
#: Fixed values of the tokenizer's pattern: letters that an apostrophe takes along.
TAKEN = ("s", "t", "m", "d", "re", "ve", "ll")


class Encoder:
    """Token ids of whole texts, from runs of one kind of characters.

    The tokenizer lowers a text and merges inside runs of letters, runs of signs and single digits only.  The runs of
    many texts are found together over arrays of characters and told apart as a dictionary, so each distinct run is looked
    up once, and new ones go through the tokenizer together: the last token of a run ends a word, which parts them.
    Texts with characters from ``LOW`` on, whose normal form may depend on neighbours, and texts that may hold special
    tokens are encoded as a whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u4") if size > 65536 else np.dtype("<u2")
        self.ends = np.zeros(size, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith(WORD_END)
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: two first bytes of a special token; texts that hold them are encoded as a whole
        self.marks = sorted({t.content.encode()[:2] for t in added})
        self.lower = np.arange(LOW, dtype=np.uint16)
        self.kinds = np.array([self._kind(p) for p in range(LOW)], dtype=np.uint8)
        cut = [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str("a'sb 12 !'s")]
        self.plain = cut == ["a", "'s", "b", "1", "2", "!'", "s"] and all(len(m) == 2 for m in self.marks)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _kind(self, point: int) -> int:
        """Kind of a character, whose lower form goes to ``lower``."""
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        made = self.tokenizer.normalizer.normalize_str(chr(point)) if self.tokenizer.normalizer else chr(point)
        if len(made) != 1 or ord(made) >= LOW:
            return ODD
        self.lower[point] = ord(made)
        if not cut(made):
            return BLANK
        if len(cut(made + made)) == 2:
            return DIGIT
        return LETTER if len(cut("a" + made)) == 1 else SIGN

    def _one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _together(self, runs: list[bytes]) -> list[bytes]:
        """Ids of runs, which are encoded as the words of one text."""
        out: list[bytes] = []
        for at in range(0, len(runs), 4096):
            some = runs[at : at + 4096]
            text = b" \0".join(some).decode("utf-16-le")
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)
            stops = (np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize
            if len(stops) != len(some):  # a tokenizer without word ends
                out += [self._one(r.decode("utf-16-le")) for r in some]
                continue
            body = ids.tobytes()
            out += [body[a:b] for a, b in zip([0, *stops.tolist()], stops.tolist())]
        return out

    def learn(self, runs: list[bytes]) -> list[bytes]:
        """Ids of distinct runs (as UTF-16); what is asked for again outlives the older generation."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        found = list(map(young.get, runs))
        if None in found:
            missing = [run for run, known in zip(runs, found, strict=True) if known is None]
            young.update((run, old[run]) for run in missing if run in old)
            new = [run for run in missing if run not in old]
            young.update(zip(new, self._together(new), strict=True))
            found = list(map(young.__getitem__, runs))
        return found

    def _starts(self, points: np.ndarray, kinds: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        """Flags of the characters that begin a run; ``breaks`` flags the first of each text."""
        start = breaks | (kinds == DIGIT)
        start[1:] |= kinds[1:] != kinds[:-1]
        marks = np.flatnonzero(start & (points == 39))
        tail = np.concatenate([points, np.zeros(3, dtype=points.dtype)])
        ends = np.concatenate([breaks, np.ones(3, dtype=bool)])
        taken = []
        for letters in TAKEN:
            same = np.ones(len(marks), dtype=bool)
            for i, letter in enumerate(letters, 1):
                same &= (tail[marks + i] == ord(letter)) & ~ends[marks + i]
            taken.append((marks[same], len(letters)))
        for found, width in taken:
            start[found + 1] = False
            after = found + 1 + width
            start[after[after < len(points)]] = True
        return start

    def _apart(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that are encoded as a whole."""
        flags = data >= 0xCC  # lead bytes of characters from LOW on
        for mark in self.marks:
            flags[:-1] |= (data[:-1] == mark[0]) & (data[1:] == mark[1])
        sums = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(flags)])
        return sums[offsets[1:]] > sums[offsets[:-1]]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (``data`` at ``offsets``), and how many each has."""
        n = len(offsets) - 1
        alone = self._apart(data, offsets) if self.plain else np.ones(n, dtype=bool)
        sizes = np.where(alone, 0, np.diff(offsets))
        body = data[np.repeat(~alone, np.diff(offsets))]
        first = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(sizes)])
        leads = (body & 0xC0) != 0x80
        at = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(leads)])[first]  # first character of each text
        points = np.frombuffer(body.tobytes().decode("utf-8").encode("utf-16-le"), dtype="<u2")
        if (odd := np.flatnonzero(self.kinds[points] == ODD)).size:
            late = np.zeros(n, dtype=bool)
            late[np.searchsorted(at, odd, side="right") - 1] = True
            alone |= late
            points = points[np.repeat(~late, np.diff(at))]
            at = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(np.where(late, 0, np.diff(at)))])
        points = self.lower[points]
        breaks = np.zeros(len(points) + 1, dtype=bool)
        breaks[at] = True
        kinds = self.kinds[points]
        solid = kinds != BLANK  # blanks part runs and have no ids
        begins = np.flatnonzero(self._starts(points, kinds, breaks[:-1])[solid])
        at = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(solid)])[at]
        points = points[solid]
        places = np.append(begins, len(points)).astype(np.int32) * 2
        runs = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(places), pa.py_buffer(points.tobytes())])
        coded = runs.dictionary_encode()
        _, marks, body = coded.dictionary.buffers()
        ends = np.frombuffer(marks, dtype=np.int32)[: len(coded.dictionary) + 1].tolist()
        body = body.to_pybytes() if body is not None else b""
        known = self.learn([body[a:b] for a, b in zip(ends, ends[1:])])
        flat = np.frombuffer(b"".join(known), dtype=self.dtype)
        counts = np.array([len(k) for k in known], dtype=np.int64) // self.dtype.itemsize
        which = coded.indices.to_numpy()
        run_sizes = counts[which]
        ids = flat[_places((np.cumsum(counts) - counts)[which], run_sizes)]
        sums = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(run_sizes)])
        each = np.diff(sums[np.searchsorted(begins, at)])
        if not alone.any():
            return ids, each
        whole = {i: np.frombuffer(self._one(data[offsets[i] : offsets[i + 1]].tobytes().decode()), dtype=self.dtype) for i in np.flatnonzero(alone).tolist()}
        ends = np.cumsum(each)
        parts = [whole[i] if i in whole else ids[ends[i] - each[i] : ends[i]] for i in range(n)]
        return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...``, ``sizes[i]`` of each, in a row."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encoding(path: str, end: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            for at, to, data, offsets in chunks(batch.column(1), CHUNK):
                ids, sizes = tool.encode(data, offsets)
                body = np.full(len(ids) + len(sizes), end, dtype=tool.dtype)
                ends = np.cumsum(sizes + 1)
                kept = np.ones(len(body), dtype=bool)
                kept[ends - 1] = False
                body[kept] = ids
                places = np.concatenate([np.zeros(1, dtype=np.int64), ends]).astype(np.int32) * tool.dtype.itemsize
                bodies = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(places), pa.py_buffer(body)])
                columns = [batch.column(0).slice(at, to - at).cast(pa.int64()), pa.array(sizes + 1, pa.int64()), bodies]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        give_back()

    return run


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end: int = 1) -> DataFrame:
    """``doc_id, n, ids`` (little-endian, two bytes each or four for a large vocabulary), the id ``end`` last."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_encoding(path, end), "doc_id long, n long, ids binary")


def _document_counts(dtype: np.dtype):
    schema = pa.schema([("token", pa.int64()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()  # all texts are encoded; the worker goes on to other operators
        give_back()
        counts = np.zeros(65536, dtype=np.int64)
        place = np.zeros(65536, dtype=np.int64)
        for batch in batches:
            for body in batch.column(0).to_pylist():
                ids = np.frombuffer(body, dtype=dtype).astype(np.int64)
                if dtype.itemsize > 2 and (most := int(ids.max())) >= len(counts):
                    more = np.zeros(most + 1 - len(counts), dtype=np.int64)
                    counts, place = np.concatenate([counts, more]), np.concatenate([place, more])
                order = np.arange(len(ids))
                place[ids] = order
                counts[ids[place[ids] == order]] += 1  # each id at one of its places
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], schema=schema)

    return run


class Shard:
    """Inverted index over some documents with ready BM25 weights.

    Postings of frequent terms are rows of a matrix, which has at most ``FREQUENT`` times as many cells as postings.
    """

    def __init__(self, ids: list[np.ndarray], weight: np.ndarray, mean: float) -> None:
        sizes = np.array([len(x) for x in ids])
        pair = np.concatenate(ids).astype(np.int64)  # one array in place: a shard has millions of tokens
        pair <<= 32
        pair |= np.repeat(np.arange(len(ids), dtype=np.int64), sizes)
        pair, count = np.unique(pair, return_counts=True)
        self.n = len(ids)
        term, doc = pair >> 32, pair & 0xFFFFFFFF
        length = sizes[doc] / mean
        score = weight[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length))
        order = np.argsort(doc, kind="stable")
        self.terms = np.split(term[order], np.searchsorted(doc[order], np.arange(1, self.n)))
        many = np.flatnonzero(np.bincount(term, minlength=len(weight)) * FREQUENT >= self.n)
        self.row = np.full(len(weight), -1, dtype=np.int64)
        self.row[many] = np.arange(len(many))
        row = self.row[term]
        self.rows, self.columns = np.zeros((len(many), self.n)), np.arange(self.n)
        self.rows[row[row >= 0], doc[row >= 0]] = score[row >= 0]
        self.every = np.arange(len(weight) + 1)
        self._hold(term[row < 0], doc[row < 0], score[row < 0])

    def _hold(self, term: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        """Postings of the other terms."""
        self.term, self.doc, self.score = term, doc, score
        self.starts = np.searchsorted(term, self.every)

    def scores(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """BM25 of all documents for the seed's terms; 0 for used ones."""
        if np.count_nonzero(unused) < SHRINK * len(self.columns):  # no later search returns what is used by now
            kept, live = unused[self.columns], unused[self.doc]
            self.rows, self.columns = self.rows[:, kept], self.columns[kept]
            self._hold(self.term[live], self.doc[live], self.score[live])
        rows = self.row[self.terms[seed]]
        rare = self.terms[seed][rows < 0]
        at = _places(self.starts[rare], self.starts[rare + 1] - self.starts[rare])
        total = np.bincount(self.doc[at], weights=self.score[at], minlength=self.n).astype(float)
        total[self.columns] += self.rows[rows[rows >= 0]].sum(axis=0)
        return np.where(unused, total, 0.0)

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """All unused documents by BM25 for the seed's terms, best first; ties by position."""
        total = self.scores(seed, unused)
        found = np.flatnonzero(total > 0)
        return found[np.argsort(-total[found], kind="stable")]


class Packer:
    """Fills windows one after the other; the last one stays open for the next shard."""

    def __init__(self, window: int, first: int) -> None:
        self.window, self.sequence, self.filled = window, first, 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            piece = ids[at : at + self.window - self.filled]
            crc = zlib.crc32(piece.astype("<u4").tobytes())
            self.rows.append((doc_id, at, len(piece), crc, len(ids), self.sequence, self.filled))
            at += len(piece)
            self.filled += len(piece)
            if self.filled == self.window:
                self.sequence, self.filled = self.sequence + 1, 0

    def room(self) -> int:
        return self.window - self.filled

    def pack(self, doc_ids: list, ids: list[np.ndarray], weight: np.ndarray, mean: float) -> None:
        index = Shard(ids, weight, mean)
        sizes = np.array([len(x) for x in ids])
        unused = np.ones(len(ids), dtype=bool)
        following, window = 0, -1
        near = nothing = np.zeros(len(ids))
        last = -1
        while True:
            if window != self.sequence or last < 0:  # a new window: its first document is the seed
                window = self.sequence
                if self.filled and last >= 0:
                    near = index.scores(last, unused)  # it was opened by what is left of a document
                elif not self.filled:
                    near = nothing
            # the best that fits whole, else the best; ties by position
            pick = int(np.argmax(np.where(sizes <= self.room(), near, 0.0)))
            if near[pick] <= 0 or sizes[pick] > self.room():
                pick = int(np.argmax(near))
            if near[pick] <= 0:
                while following < len(ids) and not unused[following]:
                    following += 1
                if following == len(ids):
                    return
                pick = following
            near[pick] = 0.0
            unused[pick] = False
            opens = self.filled == 0
            self.add(doc_ids[pick], ids[pick])
            last = pick
            if opens and self.filled and self.sequence == window:
                near = index.scores(pick, unused)


def _packing(window: int, dtype: np.dtype, weight: np.ndarray, mean: float):
    schema = pa.schema(
        [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    )

    def out(packer: Packer) -> pa.RecordBatch:
        columns = zip(*packer.rows, strict=True) if packer.rows else [[]] * len(schema)
        made = pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], schema=schema)
        packer.rows = []
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        names, ids, tokens = [], [], 0
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(name)
                ids.append(np.frombuffer(body, dtype=dtype))
                tokens += len(ids[-1])
                if len(ids) == SHARD_DOCS or tokens >= SHARD_TOKENS:
                    packer.pack(names, ids, weight, mean)
                    names, ids, tokens = [], [], 0
                    yield out(packer)
        if ids:
            packer.pack(names, ids, weight, mean)
        yield out(packer)
        del packer, names, ids
        give_back()

    return run


def pack_documents(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = 1
) -> DataFrame:
    """Pieces of all documents in sequences of ``window`` tokens.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.  Null and empty texts are the id
    ``end`` alone; repeated rows are packed as often as they come; a document longer than a window fills several; an
    empty table gives no row.  ``path`` is a tokenizer file that every executor can read.
    """
    dtype = encoder(path).dtype
    encoder.cache_clear()  # the driver encodes nothing
    give_back()
    encoded = stage(encode_documents(docs, path, doc_id, text, end), "packing-ids")
    counted = encoded.select("ids").mapInArrow(_document_counts(dtype), "token long, df long")
    rows = counted.groupBy("token").agg(F.sum("df").alias("df")).collect()  # at most one row per id of the vocabulary
    total = encoded.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("tokens")).first()
    width = max([r["token"] for r in rows], default=0) + 1
    df = np.zeros(width)
    for r in rows:
        df[r["token"]] = r["df"]
    weight = np.log1p((total["n"] - df + 0.5) / (df + 0.5)).astype(np.float64)
    mean = (total["tokens"] or 1) / max(total["n"], 1)
    pack = _packing(window, dtype, weight, mean)
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return encoded.select("doc_id", "ids").mapInArrow(pack, ", ".join(f"{n} long" for n in names))
