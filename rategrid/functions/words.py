"""Bit rows as Python integers, for use inside pandas functions.

A row of a binary matrix is one integer, bit ``c`` for column ``c``.  These few helpers
are all the row arithmetic the distributed jobs need; partitioning, grouping and merging
is Spark's work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = 64
# rows of an Arrow batch that are Python objects at one time
ROWS = 64


def rowwise(spark_type: T.DataType, arrow_type: pa.DataType):
    """A column function from a function of one row's values, with the result's type for Spark and for Arrow.

    A batch stays in Arrow's compact form; only ``ROWS`` of its rows are Python lists at a time, so the memory of a
    worker does not follow the number of matrices in a batch.
    """

    def wrap(function: Callable):
        def run(*columns: pa.Array) -> pa.Array:
            parts = []
            for start in range(0, len(columns[0]), ROWS):
                values = [c.slice(start, ROWS).to_pylist() for c in columns]
                parts.append(pa.array([function(*row) for row in zip(*values)], type=arrow_type))
            return pa.concat_arrays(parts) if parts else pa.array([], type=arrow_type)

        run.__doc__ = function.__doc__
        return F.arrow_udf(run, spark_type)

    return wrap


def from_words(words: Sequence[int]) -> int:
    return int.from_bytes(np.asarray(words, dtype="<i8").tobytes(), "little")


def to_words(value: int, count: int) -> list[int]:
    return np.frombuffer(value.to_bytes(8 * count, "little"), dtype="<i8").tolist()


def insert(basis: dict[int, int], vector: int) -> bool:
    """Reduce ``vector`` by ``basis`` (keyed by lowest set bit); keep what is left of it."""
    while vector:
        low = vector & -vector
        held = basis.get(low)
        if held is None:
            basis[low] = vector
            return True
        vector ^= held
    return False


def reduced(vectors: Iterable[int]) -> dict[int, int]:
    """Reduced echelon basis: every pivot bit occurs in its own row only."""
    basis: dict[int, int] = {}
    for vector in vectors:
        insert(basis, vector)
    pivots = sorted(basis, reverse=True)
    mask = 0
    for pivot in pivots:
        row = basis[pivot]
        rest = row & mask
        while rest:
            low = rest & -rest
            row ^= basis[low]
            rest = row & mask & ~((low << 1) - 1)
        basis[pivot] = row
        mask |= pivot
    return basis


class RowSpace:
    """Columns of a reduced basis and of its dual, each column as one integer.

    Row ``i`` of the basis is bit ``i`` of a column.  The dual has one row per column
    without pivot, so a vector lies in the row space exactly if the dual columns at its
    set bits cancel.
    """

    def __init__(self, rows: Sequence[Sequence[int]], n_cols: int) -> None:
        half = len(rows[0]) // 2 * WORD if len(rows) else WORD * ((n_cols + WORD - 1) // WORD)
        self.n = n_cols
        self.places = [*range(n_cols), *range(half, half + n_cols)]
        values = [from_words(r) for r in rows]
        pivots = [v & -v for v in values]
        pivot_set = set(pivots)
        slots: dict[int, int] = {}
        for place in self.places:
            if 1 << place not in pivot_set:
                slots[place] = len(slots)
        self.primal = [0] * (2 * n_cols)
        self.dual = [0] * (2 * n_cols)
        column_of = {place: c for c, place in enumerate(self.places)}
        for place, slot in slots.items():
            self.dual[column_of[place]] = 1 << slot
        for i, (value, pivot) in enumerate(zip(values, pivots)):
            home = column_of[pivot.bit_length() - 1]
            self.primal[home] |= 1 << i
            rest = value ^ pivot
            while rest:
                low = rest & -rest
                place = low.bit_length() - 1
                self.primal[column_of[place]] |= 1 << i
                self.dual[home] |= 1 << slots[place]
                rest ^= low

    def prefix_ranks(self, columns: list[int], order: Sequence[int]) -> list[int]:
        """Rank of the x and z columns of the first 1, 2, ... members of ``order``."""
        basis: dict[int, int] = {}
        ranks = []
        for q in order:
            insert(basis, columns[q])
            insert(basis, columns[self.n + q])
            ranks.append(len(basis))
        return ranks

    def rank(self, columns: list[int], members: Iterable[int]) -> int:
        basis: dict[int, int] = {}
        for q in members:
            insert(basis, columns[q])
            insert(basis, columns[self.n + q])
        return len(basis)

    def informative(self, members: Sequence[int]) -> bool:
        """S(A) + k - S(rest) > 0, which equals rank of A in the basis exceeding its dual rank."""
        return self.rank(self.primal, members) > self.rank(self.dual, members)

    def arc_ranks(self, columns: list[int]) -> np.ndarray:
        """Ranks of all arcs of the ring: entry (start, length - 1).

        Columns enter in the order of the ring, twice around, and the basis keeps the latest column for each pivot: the
        vectors that entered since a start are then as many as the arc from there has rank.
        """
        n = self.n
        ranks = np.zeros((n, n), dtype=np.int32)
        latest: dict[int, tuple[int, int]] = {}
        for end in range(2 * n - 1):
            for vector in (columns[end % n], columns[n + end % n]):
                insert_latest(latest, vector, end)
            entered = np.array([time for _, time in latest.values()], dtype=np.int64)
            since = np.bincount(end - entered[entered > end - n], minlength=n).cumsum()  # by length - 1
            first = max(0, end - n + 1)
            starts = np.arange(first, min(end, n - 1) + 1)
            ranks[starts, end - starts] = since[end - starts]
        return ranks


def insert_latest(basis: dict[int, tuple[int, int]], vector: int, time: int) -> None:
    """Reduce ``vector`` into a basis that holds, for each pivot, the vector that entered last."""
    while vector:
        pivot = vector & -vector
        held = basis.get(pivot)
        if held is None:
            basis[pivot] = (vector, time)
            return
        if held[1] < time:
            basis[pivot] = (vector, time)
            vector, time = vector ^ held[0], held[1]
        else:
            vector ^= held[0]
