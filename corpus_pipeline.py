"""Corpus pipeline: language ID, line dedup, near-duplicates, decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rategrid.llm.decontaminate import contamination
from rategrid.llm.language import UNKNOWN, fit_language, held_out, identify_language
from rategrid.llm.lines import dedup_lines
from rategrid.llm.neardup import marked_duplicates
from rategrid.llm.packing import pack_documents
from rategrid.llm.queries import word_tokenizer
from rategrid.llm.storage import stage
from rategrid.llm.text import digest

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.4  # below it no language holds a document together


def _keys() -> list[Column]:
    """The id as two columns without nulls, so that rows without an id join too."""
    return [F.coalesce("doc_id", F.lit(0).cast("long")).alias("_id"), F.isnull("doc_id").alias("_none")]


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without a letter and those that no language dominates go.

    The model learns from labelled documents outside the held-out fifth; without any label every document stays.
    """
    model = fit_language(docs.filter(~held_out()))
    if not model.labels:
        return docs.select(*COLUMNS)
    found = identify_language(docs, model, keep=COLUMNS[1:])
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; every document stays, with its new length."""
    kept = dedup_lines(docs, keep=("lang", "source"))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def keep_first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, one where none has an id; of repeated rows one."""
    keys = ["_id", "_none", "_m1", "_m2"]
    kept = marked_duplicates(docs).filter("kept").select(*_keys(), F.col("m1").alias("_m1"), F.col("m2").alias("_m2")).distinct()
    m1, m2 = digest(F.col("text"))
    mine = docs.select(*COLUMNS, *_keys(), m1.alias("_m1"), m2.alias("_m2"))
    # the join has placed rows by these keys already, so equal rows are neighbours without another shuffle
    same = Window.partitionBy(*keys).orderBy("_m1")
    rows = mine.join(kept, keys, "left_semi").withColumn("_at", F.row_number().over(same))
    return rows.filter("_at = 1").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = contamination(docs, items).filter("n_hit > 0").select(*_keys()).distinct()
    return docs.select(*COLUMNS, *_keys()).join(bad, ["_id", "_none"], "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in windows of 2048 tokens."""
    return pack_documents(docs, word_tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("language", keep_identified),
    ("line_dedup", drop_shared_lines),
    ("near_duplicates", keep_first_of_group),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No SQL: language ID is a trained model and packing reads a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each result is written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
