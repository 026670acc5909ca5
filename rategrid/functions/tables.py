"""Table functions for SQL: reduced rows of matrices, arcs and subsets of columns.

``register_tables(spark)`` makes them known as ``reduced_rows``, ``arc_subsets`` and ``sized_subsets``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from rategrid.functions.words import from_words, insert, reduced, to_words


@udtf
class ReducedRows:
    """Reduced echelon rows of each partition: ``reduced_rows(TABLE(rows) PARTITION BY key)``.

    ``rows`` has a column ``words`` (array<bigint>) and any others; those come back with the values of the partition's
    first row, followed by ``i`` (position of the pivot row) and ``words``.  Null rows count as zero, a matrix of zero
    rank gives no rows.  Only a basis is held, at most as many vectors as columns.  The result can be reduced again:
    partition a matrix with very many rows by (key, salt) first, then the outcome by key.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or "words" not in rows.dataType.fieldNames():
            raise ValueError("reduced_rows needs a TABLE argument with a column words")
        schema = T.StructType([f for f in rows.dataType.fields if f.name not in ("words", "i")])
        return AnalyzeResult(schema.add("i", T.IntegerType()).add("words", T.ArrayType(T.LongType())))

    def __init__(self) -> None:
        self.basis: dict[int, int] = {}
        self.first: tuple | None = None
        self.width = 0

    def eval(self, row: Row) -> None:
        if self.first is None:
            self.first = tuple(v for name, v in zip(row.__fields__, row) if name not in ("words", "i"))
        if row["words"]:
            self.width = max(self.width, len(row["words"]))
            insert(self.basis, from_words(row["words"]))

    def terminate(self) -> Iterator[tuple]:
        rows = reduced(self.basis.values())
        for i, pivot in enumerate(sorted(rows)):
            yield (*self.first, i, to_words(rows[pivot], self.width))


@udtf(returnType="start int, ell int, members array<int>")
class ArcSubsets:
    """All arcs of a ring of ``n_cols`` columns, shorter than the ring: ``start``, length ``ell`` and the columns."""

    def eval(self, n_cols: int) -> Iterator[tuple]:
        for start in range(n_cols or 0):
            for ell in range(1, n_cols):
                yield start, ell, [(start + j) % n_cols for j in range(ell)]


@udtf(returnType="members array<int>")
class SizedSubsets:
    """All subsets of ``size`` of ``n_cols`` columns in lexical order, one at a time; nothing for a null."""

    def eval(self, n_cols: int, size: int) -> Iterator[tuple]:
        if n_cols is not None and size is not None and 0 <= size <= n_cols:
            for members in combinations(range(n_cols), size):
                yield (list(members),)


def register_tables(spark: SparkSession) -> None:
    for name, function in {"reduced_rows": ReducedRows, "arc_subsets": ArcSubsets, "sized_subsets": SizedSubsets}.items():
        spark.udtf.register(name, function)
