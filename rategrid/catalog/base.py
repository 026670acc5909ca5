"""Registry of the queries the driver runs, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tie_offset(digits: int) -> float:
    return float(f"3e-{digits + 2}")


class Tables:
    """Lazy readers of the driver's Parquet tables in one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    digits: int

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.rounded(self.build(Tables(spark, folder)))

    def rounded(self, df: DataFrame) -> DataFrame:
        """Round doubles so that both engines agree on the last digits they print.

        Engines differ on exact ties (a mean over 32 cents-valued rows, say), so both sides
        add the same small offset before rounding.
        """
        out = []
        for field in df.schema.fields:
            column = F.col(f"`{field.name}`")
            if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
                shifted = column.cast("double") + F.lit(tie_offset(self.digits))
                column = (F.round(shifted, self.digits) + F.lit(0.0)).alias(field.name)
            out.append(column)
        return df.select(*out)


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None, doubles: Sequence[str] = (), digits: int = 6):
    """Register a query; ``doubles`` are the SQL columns rounded like the Spark result."""
    if sql is not None and doubles:
        parts = ", ".join(f'round(CAST("{c}" AS DOUBLE) + {tie_offset(digits)!r}, {digits}) + 0.0 AS "{c}"' for c in doubles)
        sql = f"SELECT * REPLACE ({parts}) FROM ({sql}) AS result"

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in CATALOG:
            raise ValueError(f"query {name!r} registered twice")
        CATALOG[name] = Query(name, build, sql, digits)
        return build

    return add
