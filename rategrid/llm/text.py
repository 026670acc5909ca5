"""Native text expressions: words, lines, digests and matches with their positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "[\\x20\\x09-\\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole(text: str | Column) -> Column:
    """The text, an empty one for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Where all characters are ASCII the plain (and faster) lower() does just that."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def words(text: Column, gap: str = BLANK) -> Column:
    """The maximal runs of characters outside ``gap``."""
    return F.array_remove(F.split(text, gap), "")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def digest(text: Column) -> list[Column]:
    """Two 64-bit hashes: 128 bits name a text, a line or a window."""
    return [F.xxhash64(text), F.xxhash64(F.lit(7), text)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(left: Column, right: Column, by: int, f: Callable[[Column, Column], Column]) -> Column:
    """Element i is ``f(left[i], right[i + by])`` as long as both exist.  Both must be cheap to name."""
    count = F.greatest(F.size(right) - by, F.lit(0))
    return F.slice(F.zip_with(left, F.slice(right, by + 1, count), f), 1, count)


def gram_hashes(tokens: Column, k: int) -> Column:
    """Hash of every run of ``k`` tokens, in order; runs are put together from halves."""

    def pair(a: Column, b: Column) -> Column:
        return F.xxhash64(a, b)

    def grow(single: Column, made: Column, length: int, bits: str) -> Column:
        if not bits:
            return made
        twice = fold(made, made, length, pair)
        if bits[0] == "0":
            return let(twice, lambda m: grow(single, m, 2 * length, bits[1:]))
        return let(twice, lambda m: let(fold(m, single, 2 * length, pair), lambda o: grow(single, o, 2 * length + 1, bits[1:])))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda s: grow(s, s, 1, bin(k)[3:]))


def sliding_least(values: Column, width: int) -> Column:
    """The smallest of every ``width`` neighbours, in order.  ``values`` must be cheap to name."""

    def grow(made: Column, length: int) -> Column:
        if length == width:
            return made
        by = min(length, width - length)
        return let(fold(made, made, by, lambda a, b: F.least(a, b)), lambda m: grow(m, length + by))

    return grow(values, 1)


MATCHES = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, value) in code points, end exclusive.

    The pieces between matches give the positions: each match starts after all pieces and matches before it.
    ``pattern`` must not match an empty text.
    """

    def placed(found: Column) -> Column:
        pairs = F.zip_with(
            found,
            F.slice(F.split(text, pattern), 1, F.size(found)),
            lambda m, gap: F.struct(F.char_length(gap).alias("gap"), m.alias("value")),
        )
        start = F.struct(F.lit(0).alias("pos"), F.array().cast(MATCHES).alias("out"))

        def add(state: Column, x: Column) -> Column:
            begin = state["pos"] + x["gap"]
            end = begin + F.char_length(x["value"])
            span = F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"))
            return F.struct(end.alias("pos"), F.concat(state["out"], F.array(span)).alias("out"))

        made = F.aggregate(pairs, start, add, lambda s: s["out"])
        return F.when(F.size(found) > 0, made).otherwise(F.array().cast(MATCHES))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def spans_of(found: Column, kind: str, order: int) -> Column:
    """Matches as spans that sort by start, then by the place of their kind."""
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind")
        ),
    )


SPAN = "struct<start:int,order:int,end:int,kind:string>"


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    ordered = F.array_sort(spans)
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
