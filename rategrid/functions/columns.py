"""Column lookup, folding of dotted names and small join helpers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rategrid.session import cut_lineage


def leaves(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """Dotted path and type of every non-struct field."""
    found: list[tuple[str, T.DataType]] = []
    for field in schema.fields:
        path = prefix + field.name
        if isinstance(field.dataType, T.StructType):
            found += leaves(field.dataType, path + ".")
        else:
            found.append((path, field.dataType))
    return found


def has_column(df: DataFrame, name: str) -> bool:
    return any(path == name for path, _ in leaves(df.schema))


def require_column(df: DataFrame, name: str) -> None:
    if not has_column(df, name):
        known = sorted(path for path, _ in leaves(df.schema))
        raise KeyError(f"column {name!r} not found; known columns: {known}")


def numeric_columns(df: DataFrame, skip: Iterable[str] = ("sample_seed",)) -> list[str]:
    """Numeric leaf columns; booleans do not count as numeric."""
    skipped = set(skip)
    return [path for path, kind in leaves(df.schema) if isinstance(kind, T.NumericType) and path not in skipped]


def fold_dotted(df: DataFrame) -> DataFrame:
    """Turn literal ``a.b`` columns into struct fields, so ``obs.k > 0`` is plain SQL."""
    groups: dict[str, list[str]] = {}
    for name in df.columns:
        head, dot, _ = name.partition(".")
        groups.setdefault(head if dot else name, []).append(name)
    selected = []
    for head, names in groups.items():
        if names == [head]:
            selected.append(F.col(f"`{head}`"))
        else:
            members = [F.col(f"`{c}`").alias(c.partition(".")[2] or c) for c in names]
            selected.append(F.struct(*members).alias(head))
    return df.select(*selected)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` that also pairs nulls; the keys come from the left side."""
    named = right.select(*[F.col(k).alias(f"_on_{k}") if k in keys else F.col(f"`{k}`") for k in right.columns])
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(named[f"_on_{key}"])
    return left.join(named, condition, how).drop(*[f"_on_{k}" for k in keys])


def frame_bytes(df: DataFrame) -> int:
    """Bytes of the rows as JSON text: a fair size for a decision to broadcast."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))).first()[0] or 0


HOT_SHARE = 200  # a key with more than one in so many rows is hot; there can be no more hot keys than that


def attach_summary(
    big: DataFrame,
    summary: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    max_broadcast_bytes: int = 32 << 20,
    salts: int = 32,
    ready: bool = False,
) -> DataFrame:
    """Join ``summary`` rows onto ``big`` without sending all rows of a hot key to one task.

    Null keys match each other.  The summary is materialised (unless ``ready`` says it is) and its bytes are counted.
    Up to ``max_broadcast_bytes`` it is broadcast.  Beyond that both sides shuffle, and only hot keys are salted: at
    most ``HOT_SHARE`` keys hold more than that share of the rows, so their list is always small.  The salt is the
    position of a row, so equal rows of a hot key spread too.
    """
    keys = list(keys)
    summary = summary if ready else cut_lineage(summary)
    if frame_bytes(summary) <= max_broadcast_bytes:
        return join_on(big, F.broadcast(summary), keys, how)
    counts = cut_lineage(big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")))
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    hot = counts.where(F.col("_rows") * HOT_SHARE > total).select(*keys, F.lit(True).alias("_hot"))
    position = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    marked = join_on(big.withColumn("_at", position), F.broadcast(hot), keys, "left")
    spread = marked.withColumn("_salt", F.when(F.col("_hot"), F.col("_at")).otherwise(0)).drop("_at", "_hot")
    places = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copies = join_on(summary, F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(places)).drop("_hot")
    return join_on(spread, copies, [*keys, "_salt"], how).drop("_salt")
