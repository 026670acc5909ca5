"""Benchmark records in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def clean_records(df: DataFrame, time: str = "time") -> DataFrame:
    """Drop failed records and those without a positive time."""
    if "error" in df.columns:
        df = df.where("error is null").drop("error")
    return df.where(F.col(time) > 0)


def load_records(spark: SparkSession, paths: str | list[str], time: str | None = "time") -> DataFrame:
    """Records from JSON arrays; ``time=None`` keeps every record."""
    df = spark.read.json(paths, multiLine=True)
    return df if time is None else clean_records(df, time)
