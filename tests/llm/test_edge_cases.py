"""Every operator and stage on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

import corpus_pipeline
from rategrid.llm import decontaminate, language, lines, neardup, packing, pii, rules, secrets, sharding, substrings
from rategrid.llm.queries import word_tokenizer

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside
        *[T.StructField(c, T.StringType()) for c in ("mark", "n", "h", "words", "spans", "shard", "node", "score", "lo")],
    ]
)
LONG = " ".join(f"word{i % 997} and" for i in range(20_000))
TEXTS = [
    (1, "Plain words make a plain document that nobody would ever reject for anything at all."),
    (1, "Plain words make a plain document that nobody would ever reject for anything at all."),  # repeated row
    (2, "Plain words make a plain document that nobody would ever reject for anything at all."),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (None, "A row without an id has words as well, more than ten of them in fact."),
    (None, None),
    (6, LONG),
    (7, "x" * 200_000),
    (8, "9" * 100_000 + " token=abc mail a@b.c.d"),
    (9, "\n" * 5000),
    (10, "été à la plage, où ÉTÉ est l'été; 中文 字 \U0001f600 password: hunter2x"),
    (11, "a@" + "b." * 20_000 + "c " + "1." * 20_000 + " +1 2" + " 3" * 20_000),
    (12, "one"),
    (12, "another text under the same id"),
]


def table(spark, rows):
    full = [(i, t, None if i == 3 else "en" if (i or 0) % 2 else "fr", None, None, *["clash"] * 9) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "make a plain document that nobody would ever reject for anything"), (2, None), (3, ""), (None, "a row without an id")]
    return spark.createDataFrame(rows, "item_id long, text string")


def language_rows(docs):
    model = language.fit_language(docs)
    return language.identify_language(docs, model)


OPERATORS = {
    "secrets": secrets.scan_secrets,
    "sharding": sharding.shard_documents,
    "language": language_rows,
    "near_duplicates": neardup.near_duplicates,
    "pii": pii.find_pii,
    "substrings": substrings.dedup_substrings,
    "rules": rules.judge,
    "lines": lines.dedup_lines,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_per_input_row(docs, empty, name):
    rows = OPERATORS[name](docs).collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    assert ids == sorted((i is None, i or 0) for i, _ in TEXTS)
    assert OPERATORS[name](empty).collect() == []


def test_decontamination(docs, empty, items):
    rows = decontaminate.contamination(docs, items).collect()
    assert len(rows) == len(TEXTS)
    by_id = {(r["doc_id"], r["n_words"]): r for r in rows}
    assert by_id[(2, 15)]["n_hit"] == 11 and by_id[(2, 15)]["items"] == ["1"]
    short = by_id[(None, 16)]  # an item of five words is one window
    assert short["n_hit"] == 5 and short["items"] == [""]
    assert by_id[(3, 0)]["n_hit"] == 0 and by_id[(3, 0)]["items"] == []
    assert decontaminate.contamination(empty, items).collect() == []
    none = decontaminate.contamination(docs, items.limit(0)).collect()
    assert len(none) == len(TEXTS) and not any(r["n_hit"] for r in none)


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, word_tokenizer()).collect()
    assert {r["doc_id"] for r in rows} == {i for i, _ in TEXTS}
    assert sum(r["length"] for r in rows if r["doc_id"] == 3) == 1  # null text: the end id alone
    assert packing.pack_documents(empty, word_tokenizer()).collect() == []


def test_defined_results(docs):
    found = {(r["doc_id"], r["n_shingles"]): r for r in neardup.near_duplicates(docs).collect()}
    assert found[(2, 11)]["component_id"] == 1 and not found[(2, 11)]["kept"]
    assert found[(3, 0)]["component_id"] == 3 and found[(3, 0)]["kept"]
    assert found[(12, 1)] and found[(4, 0)]["kept"]
    removed = {r["doc_id"]: r for r in substrings.dedup_substrings(docs).collect()}
    assert removed[3]["n_words"] == 0 and removed[6]["n_removed"] > 30_000  # its own words come back
    kinds = {r["doc_id"]: r for r in secrets.scan_secrets(docs).collect()}
    assert [m["value"] for m in kinds[10]["assign"]] == ["password: hunter2x"]
    assert kinds[8]["assign"] == []  # three characters are too few
    mail = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert [m["value"] for m in mail[8]["email"]] == ["a@b.c.d"] and len(mail[11]["email"]) == 1
    und = {r["doc_id"]: r for r in language_rows(docs).collect() if r["doc_id"] is not None}
    assert und[3]["lang_pred"] == "und" and und[9]["lang_pred"] == "und" and und[3]["score"] == 0.0
    verdict = {r["doc_id"]: r for r in rules.judge(docs).collect() if r["doc_id"] is not None}
    assert verdict[3]["base_failed"] and not verdict[3]["kept"] and verdict[2]["kept"]


def test_language_without_labels(docs):
    model = language.train([], [])
    assert {r["lang_pred"] for r in language.identify_language(docs, model).collect()} == {"und"}


def test_sanitize_and_filter(docs):
    clean = {r["doc_id"]: r["text"] for r in pii.sanitize(docs).collect() if r["doc_id"] is not None}
    assert clean[8].endswith("mail [EMAIL]") and clean[3] == ""
    passed = rules.filter_quality(docs)
    assert passed.columns == docs.columns and {2, 10} <= {r["doc_id"] for r in passed.collect()}


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_pipeline_stage(spark, docs, empty, at):
    name, step = corpus_pipeline.STAGES[at]
    folder = "/root/testdata/sf0.001"
    rows = step(spark, docs, folder)
    if at < len(corpus_pipeline.STAGES) - 1:
        assert rows.columns == corpus_pipeline.COLUMNS
        assert 2 in {r["doc_id"] for r in rows.collect()} or name == "near_duplicates"
    else:
        assert {r["doc_id"] for r in rows.collect()} == {i for i, _ in TEXTS}
    assert step(spark, empty, folder).collect() == []


def test_rows_without_an_id_are_told_apart(spark):
    """Two texts of equal 32-bit hash and no id, and near copies of which none has an id."""
    passage, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "pq")
    made = spark.range(200_000).selectExpr(f"concat('{passage} a', id) AS x", f"concat('{other} b', id) AS y")
    a, b = made.selectExpr("x", "hash(x) AS m").join(made.selectExpr("y", "hash(y) AS m"), "m").select("x", "y").first()
    rows = [(None, a), (None, b), (1, passage + " more of it")]
    removed = {r["text"]: r["n_removed"] for r in substrings.dedup_substrings(table(spark, rows)).collect()}
    assert removed[b] == 0 and len(removed) == 3
    copies = [(None, " ".join(f"w{i}" for i in range(100 + n))) for n in range(3)]
    kept = [r["text"] for r in corpus_pipeline.keep_first_of_group(spark, table(spark, [(None, a), (None, b), *copies, copies[0]]), "").collect()]
    assert len(kept) == 3 and {a, b} <= set(kept)
