"""Sinks for small streaming results and gap filling of arriving cells."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rategrid.session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", per_trigger: int = 1000) -> DataFrame:
    """Parquet files arriving in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return reader.option("maxFilesPerTrigger", per_trigger).parquet(folder)


def drain(stream: DataFrame, name: str, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """Process everything available and return the sink's rows as a table.

    ``complete`` replaces the table with every batch, ``append`` adds to it, ``update`` keeps the latest row of each
    ``keys``; a batch that is repeated after a failure overwrites its own folder, so no row is written twice.
    """
    spark = stream.sparkSession
    target, journal = scratch(spark, name), scratch(spark, name + "-journal")

    def write(batch: DataFrame, epoch: int) -> None:
        folder = target if mode == "complete" else f"{target}/batch={epoch}"
        batch.write.mode("overwrite").parquet(folder)

    running = stream.writeStream.outputMode(mode).option("checkpointLocation", journal)
    running.foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    result = spark.read.schema(stream.schema).parquet(target)
    if mode == "update":
        values = [c for c in stream.columns if c not in keys]
        latest = result.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_row"))
        return latest.select(*keys, "_row.*").select(*stream.columns)
    return result.drop("batch")


def fill_gaps(stream: DataFrame, fill: Callable[[DataFrame], None], journal: str, **trigger):
    """Start a query that hands each batch of newly arrived cells to ``fill``."""

    def step(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            fill(batch)

    writer = stream.writeStream.option("checkpointLocation", journal).foreachBatch(step)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
