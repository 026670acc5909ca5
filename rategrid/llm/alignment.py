"""Alignment of two tokenizers by byte offsets, with an identity map as the fast path.

Offsets where tokens of both tokenizers end cut a text into groups.  Most groups hold one token of each side; both then
stand for the same bytes, so an array from A ids to the B ids of the same bytes, made once, names the pair by its A id
alone.  Documents that hold such a pair are counted in vectors as long as the vocabulary, one for each task, and only the
pairs of irregular groups are shuffled.  Counts of the most frequent of these go back to the documents in a table of
fixed size; the others, of which none is frequent, meet their counts in a join.

Texts go through both tokenizers whole; groups and links of many documents are then found together over flat arrays.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rategrid.llm.hashing import chunks
from rategrid.llm.storage import stage

FREQUENT = 1 << 17  # irregular pairs whose counts are broadcast
SPACE_SIGN = "▁"  # how the second tokenizer writes a space


def _byte_of_sign() -> dict[str, int]:
    """Signs of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Entries:
    """Bytes of a vocabulary behind one another."""

    def __init__(self, entries: list[bytes]) -> None:
        self.sizes = np.array([len(x) for x in entries], dtype=np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(entries), dtype=np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The joined bytes of ``ids``."""
        return self.data[_runs(self.first[ids], self.sizes[ids])]


class Aligner:
    """Both tokenizers, the bytes of their entries and the map of identical ones."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        signs = _byte_of_sign()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(pieces)
        ]
        of_bytes: dict[bytes, int] = {}
        for i, p in enumerate(self.bytes_b):
            if not (self.b.is_control(i) or self.b.is_unknown(i)):
                of_bytes.setdefault(p, i)
        self.same = np.array([of_bytes.get(x, -1) if x else -1 for x in self.bytes_a], dtype=np.int64)
        self.entries_a, self.entries_b = Entries(self.bytes_a), Entries(self.bytes_b)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides: A gets the space in front of a text, B puts it itself."""
        side_a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [x.ids for x in side_a], self.b.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places ``starts[i], starts[i] + 1, ...``, ``sizes[i]`` of each, in a row."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and how many each text has."""
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    return np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(sizes.sum())), sizes


def _given_back(entries: Entries, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts (``data`` at ``offsets``) are the joined bytes of their ids?"""
    of_text = np.repeat(np.arange(len(sizes)), sizes)
    spelled = np.bincount(of_text, weights=entries.sizes[ids], minlength=len(sizes)).astype(np.int64)
    good = spelled == np.diff(offsets)
    kept = good[of_text]
    text = data[_runs(offsets[:-1][good], spelled[good])]
    differ = np.flatnonzero(entries.spell(ids[kept]) != text)
    good[np.repeat(np.flatnonzero(good), spelled[good])[differ]] = False
    return good


@dataclass
class Groups:
    """Groups of some texts in a row: first token of each on both sides (with the end), and the first group of each text."""

    first_a: np.ndarray
    first_b: np.ndarray
    first: np.ndarray


def _groups(tool: Aligner, a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, sizes_b: np.ndarray) -> Groups:
    """Texts of equal bytes on both sides, cut where tokens of both end."""
    end_a, end_b = np.cumsum(tool.entries_a.sizes[a]), np.cumsum(tool.entries_b.sizes[b])
    marks = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, dtype=np.uint8)
    marks[end_a] = 1
    marks[end_b] += 1
    last_a, last_b = np.flatnonzero(marks[end_a] == 2), np.flatnonzero(marks[end_b] == 2)
    first_a, first_b = np.append(0, last_a + 1), np.append(0, last_b + 1)
    return Groups(first_a, first_b, np.searchsorted(first_a, np.append(0, np.cumsum(sizes_a))))


def _counted_in(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of each group with their numbers; groups ascend."""
    code, times = np.unique(group << 32 | ids, return_counts=True)
    return code >> 32, code & 0xFFFFFFFF, times


def _links(a: np.ndarray, b: np.ndarray, groups: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, A id, B id and number of all links, in rows of distinct ids for each group."""
    many_a, many_b = np.diff(groups.first_a), np.diff(groups.first_b)
    of_text = np.repeat(np.arange(len(groups.first) - 1), np.diff(groups.first))
    plain = (many_a == 1) & (many_b == 1)
    one_a, one_b = a[groups.first_a[:-1][plain]], b[groups.first_b[:-1][plain]]
    rough = np.flatnonzero(~plain)
    group_a, id_a, times_a = _counted_in(np.repeat(rough, many_a[rough]), a[_runs(groups.first_a[rough], many_a[rough])])
    group_b, id_b, times_b = _counted_in(np.repeat(rough, many_b[rough]), b[_runs(groups.first_b[rough], many_b[rough])])
    lo, hi = np.searchsorted(group_b, group_a), np.searchsorted(group_b, group_a, side="right")
    other = _runs(lo, hi - lo)
    mine = np.repeat(np.arange(len(group_a)), hi - lo)
    return (
        np.concatenate([of_text[plain], of_text[group_a[mine]]]),
        np.concatenate([one_a, id_a[mine]]),
        np.concatenate([one_b, id_b[other]]),
        np.concatenate([np.ones(len(one_a), dtype=np.int64), times_a[mine] * times_b[other]]),
    )


def _told(ids: np.ndarray, first: np.ndarray) -> pa.Array:
    """The ids of each group, comma-joined."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids).cast(pa.string())), ",")


def _tallied(text: np.ndarray, code: np.ndarray, times: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """Distinct codes of each text with their numbers."""
    order = np.lexsort((code, text))
    text, code, times = text[order], code[order], times[order]
    first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (code[1:] != code[:-1]))[: len(text)])
    sums = np.add.reduceat(times, first) if len(first) else times
    ends = pa.array(np.searchsorted(text[first], np.arange(n + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(code[first])), pa.ListArray.from_arrays(ends, pa.array(sums))


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_LISTS = ("same", "same_n", "pairs", "pair_n")
ALIGNED = ", ".join(["row long", "doc_id long", *[f"{c} long" for c in _COUNTS], "groups_sha256 string", "groups string", *[f"{c} array<long>" for c in _LISTS]])


def _aligning(path_a: str, path_b: str, with_groups: bool):
    long_list = pa.list_(pa.int64())
    schema = pa.schema(
        [
            *[(c, pa.int64()) for c in ("row", "doc_id", *_COUNTS)],
            *[(c, pa.string()) for c in ("groups_sha256", "groups")],
            *[(c, long_list) for c in _LISTS],
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(path_a, path_b)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(1)
            # the sign of a space stands for a space in entries of the second side: such a text never comes back
            without = pc.or_(pc.equal(pc.binary_length(texts.fill_null("")), 0), pc.match_substring(texts.fill_null(""), SPACE_SIGN))
            spaced = pc.if_else(without, "", pc.binary_join_element_wise(" ", texts.fill_null(""), ""))
            for at, to, data, offsets in chunks(spaced):
                n = to - at
                ids_a, ids_b = tool.encode([x[1:] for x in spaced.slice(at, n).to_pylist()])
                (a, sizes_a), (b, sizes_b) = _flat(ids_a), _flat(ids_b)
                good = np.diff(offsets) > 0
                good &= _given_back(tool.entries_a, a, sizes_a, data, offsets) & _given_back(tool.entries_b, b, sizes_b, data, offsets)
                a, b = a[np.repeat(good, sizes_a)], b[np.repeat(good, sizes_b)]
                sizes_a, sizes_b = np.where(good, sizes_a, 0), np.where(good, sizes_b, 0)
                groups = _groups(tool, a, sizes_a, b, sizes_b)
                text, id_a, id_b, times = _links(a, b, groups)
                links = np.zeros(n, dtype=np.int64)
                np.add.at(links, text, times)
                told = pc.binary_join_element_wise(_told(a, groups.first_a), _told(b, groups.first_b), "|")
                told = pc.binary_join(pa.ListArray.from_arrays(pa.array(groups.first.astype(np.int32)), told), ";")
                digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in told.to_pylist()]
                alike = tool.same[id_a] == id_b
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)),
                        batch.column(0).slice(at, n).cast(pa.int64()),
                        *[pa.array(c.astype(np.int64)) for c in (sizes_a, sizes_b, np.diff(groups.first), links)],
                        pa.array(digests, pa.string()),
                        told if with_groups else pa.nulls(n, pa.string()),
                        *_tallied(text[alike], id_a[alike], times[alike], n),
                        *_tallied(text[~alike], id_a[~alike] << 32 | id_b[~alike], times[~alike], n),
                    ],
                    schema=schema,
                )
                row += n

    return run


def align_documents(
    docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str | Column = "text", groups: bool = True
) -> DataFrame:
    """One written row for each row of ``docs``: counts, groups, and its links.

    ``same`` are the A ids linked with the B id of the same bytes and ``same_n`` how often; ``pairs`` are all other
    linked ids as ``a << 32 | b``, with ``pair_n``.  ``groups`` is ``a1,a2|b1;a3|b2,b3``, null if not wanted.
    """
    text = F.col(text) if isinstance(text, str) else text
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text.alias("text"))
    return stage(rows.mapInArrow(_aligning(path_a, path_b, groups), ALIGNED), "alignment")


def _vectors(size: int):
    """Documents with each A id in a task, counted in one vector."""
    schema = pa.schema([("a", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.int64)
        for batch in batches:
            counts += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], schema=schema)

    return run


def pair_counts(aligned: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Documents with each identical pair (``a, docs``) and with each irregular one (``pair, docs``)."""
    same = aligned.select("same").mapInArrow(_vectors(size), "a long, docs long").groupBy("a").agg(F.sum("docs").alias("docs"))
    pairs = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    return same, stage(pairs, "alignment-pairs")


@dataclass
class Known:
    """Counts of bounded size: by A id for identical pairs, the best of each A id, and the frequent irregular pairs."""

    same: np.ndarray
    best: np.ndarray
    pairs: np.ndarray
    docs: np.ndarray

    def sums(self, place: np.ndarray, codes: np.ndarray, counts: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Links at the best count and the sum of counts for each row, from codes whose A id is in the upper half."""
        best, total = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        np.add.at(best, place, times * (counts == self.best[codes >> 32]))
        np.add.at(total, place, times * counts)
        return best, total

    def pair_docs(self, codes: np.ndarray) -> np.ndarray:
        """Documents of irregular pairs, 0 for those that are not frequent."""
        if not len(self.pairs):
            return np.zeros(len(codes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        return np.where(self.pairs[at] == codes, self.docs[at], 0)


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row of each list element, and the elements."""
    sizes = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy()


JUDGED = ", ".join([*[f"{c} long" for c in ("row", "doc_id", *_COUNTS)], "groups_sha256 string", "n_best long", "count_sum long"])


def _judging(known):
    """Sums over the links whose counts are known to every task, beside the other columns of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = known.value
        for batch in batches:
            n = batch.num_rows
            same, same_n, pairs, pair_n = (batch.column(c) for c in _LISTS)
            place, ids = _listed(same)
            best, total = counts.sums(place, ids << 32, counts.same[ids], same_n.flatten().to_numpy(), n)
            place, codes = _listed(pairs)
            docs, times = counts.pair_docs(codes), pair_n.flatten().to_numpy()
            there = docs > 0
            more = counts.sums(place[there], codes[there], docs[there], times[there], n)
            passed = [batch.column(c) for c in batch.schema.names if c not in _LISTS]
            names = [*(c for c in batch.schema.names if c not in _LISTS), "n_best", "count_sum"]
            yield pa.RecordBatch.from_arrays([*passed, pa.array(best + more[0]), pa.array(total + more[1])], names=names)

    return run


def _rare(known):
    """Links whose counts have to be looked up: ``row, pair, times``."""
    schema = pa.schema([(c, pa.int64()) for c in ("row", "pair", "times")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = known.value
        for batch in batches:
            place, codes = _listed(batch.column(1))
            left = counts.pair_docs(codes) == 0
            columns = [batch.column(0).to_numpy()[place[left]], codes[left], batch.column(2).flatten().to_numpy()[left]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return run


def known_counts(same: DataFrame, pairs: DataFrame, size: int, frequent: int = FREQUENT) -> Known:
    """What every task may hold: three numbers for each A id and ``frequent`` pairs at most."""
    counts, best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for row in same.collect():  # at most one row per A id
        counts[row["a"]] = best[row["a"]] = row["docs"]
    heads = pairs.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("docs"))
    for row in heads.collect():  # at most one row per A id
        best[row["a"]] = max(best[row["a"]], row["docs"])
    top = pairs.orderBy(F.desc("docs"), "pair").limit(frequent).toArrow()
    codes, docs = top.column("pair").to_numpy(), top.column("docs").to_numpy()
    order = np.argsort(codes)
    return Known(counts, best, codes[order], docs[order])


def align_tokenizers(
    docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str | Column = "text", frequent: int = FREQUENT
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``.

    A (a byte-level BPE file) encodes the text behind a space, B (a sentencepiece model) the text; special strings are
    plain text.  A link is a pair of tokens of one group; its count is the number of rows of ``docs`` that hold its ids
    linked.  Null and empty texts, and texts that B does not give back byte for byte, have no tokens: zeros and an empty
    ``groups_sha256``.  Repeated rows count as often as they come; a null ``doc_id`` stays null; an empty table gives no
    row.
    """
    size = len(aligner(path_a, path_b).bytes_a)
    aligned = align_documents(docs, path_a, path_b, doc_id, text, groups=False)
    same, pairs = pair_counts(aligned, size)
    best = known_counts(same, pairs, size, frequent)
    known = docs.sparkSession.sparkContext.broadcast(best)
    base = aligned.select("row", "doc_id", *_COUNTS, "groups_sha256", *_LISTS).mapInArrow(_judging(known), JUDGED)
    rare = aligned.select("row", "pairs", "pair_n").mapInArrow(_rare(known), "row long, pair long, times long")
    heads = F.broadcast(_heads(docs, best.best))
    met = rare.join(pairs, "pair").join(heads, F.shiftright("pair", 32) == F.col("a"))
    more = met.groupBy("row").agg(
        F.sum(F.when(F.col("docs") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("docs")).alias("more_sum"),
    )
    full = base.join(more, "row", "left")
    return full.select(
        "doc_id",
        *_COUNTS,
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )


def _heads(docs: DataFrame, best: np.ndarray) -> DataFrame:
    """The best count of each A id: as many rows as the vocabulary."""
    seen = np.flatnonzero(best)
    table = pa.table({"a": pa.array(seen), "best": pa.array(best[seen])})
    return docs.sparkSession.createDataFrame(table)
