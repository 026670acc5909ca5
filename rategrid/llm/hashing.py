"""Vectorised word and window hashes over Arrow text columns, for operators that work in Python.

Texts are handled as UTF-8 bytes, many documents at a time; all blanks and A-Z are single bytes, so bytes are enough.
Hashes are polynomial sums modulo 2^64 over random byte (or word) values, so that every word and window is a
difference of two prefix sums; a final mix spreads the bits.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
pa.set_memory_pool(pa.system_memory_pool())  # buffers of large batches go back to the system at once
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task and serves other operators."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def powers(base: int, count: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64; kept between batches."""
    have = _POWERS.get(base)
    if have is None or len(have) < count:
        grown = np.full(max(count, 2 * CHUNK_BYTES), base, dtype=np.uint64)
        grown[0] = 1
        have = _POWERS[base] = np.cumprod(grown, dtype=np.uint64)
    return have[:count]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    """Word hashes of some documents in a row; document d has words ``first[d]`` to ``first[d + 1]``."""

    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, k: int, base: int = _WORD_BASE) -> np.ndarray:
        """Hash of the ``k`` words from each position; positions too close to the end of the table are missing."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, dtype=np.uint64)
        sums = self.sums(base)
        return mixed((sums[k:] - sums[:-k]) * powers(inverse(base), n - k + 1))

    def sums(self, base: int = _WORD_BASE) -> np.ndarray:
        n = len(self.hashes)
        out = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.hashes * powers(base, n), out=out[1:])
        return out

    def spans(self, lo: np.ndarray, hi: np.ndarray, base: int = _WORD_BASE) -> np.ndarray:
        """Hash of the words lo to hi (exclusive) for each pair, their number mixed in."""
        sums = self.sums(base)
        raw = (sums[hi] - sums[lo]) * powers(inverse(base), len(self.hashes) + 1)[lo]
        return mixed(raw + (hi - lo).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def valid_starts(self, k: int) -> np.ndarray:
        """Positions from which ``k`` words of the same document follow."""
        n = len(self.hashes)
        ends = np.repeat(self.first[1:], self.counts)
        return np.flatnonzero(np.arange(n) + k <= ends)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of documents whose bytes are ``data[offsets[d]:offsets[d + 1]]``."""
    n = len(data)
    if lower:
        data = _LOWER[data]
    solid = ~_BLANK[data]
    breaks = np.zeros(n + 1, dtype=bool)
    breaks[offsets] = True
    before = np.empty(n, dtype=bool)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | breaks[:n]))
    after = np.empty(n, dtype=bool)
    after[n - 1 :] = False
    after[: n - 1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | breaks[1:])) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, n), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * powers(inverse(_BASE), n + 1)[starts]
    hashes = mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return Words(hashes, np.searchsorted(starts, offsets))


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``most`` bytes: first row, end row, their bytes and row offsets.  Null is empty."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    rows = len(texts)
    if not rows:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    _, places, body = texts.buffers()
    offsets = np.frombuffer(places, dtype=kind)[texts.offset : texts.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < rows:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), rows)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
