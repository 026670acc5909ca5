"""Memory of a Python worker that tells languages."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from rategrid.llm import language

KINDS = {"aa": "bcdf", "bb": "ghjk", "cc": "lmnp"}


def texts_of(count: int, words: int) -> list[tuple[str, str]]:
    draw = np.random.default_rng(8)
    labels = list(KINDS)
    made = []
    for d in range(count):
        label = labels[d % len(labels)]
        letters = np.array(list(KINDS[label] + "aeiou"))
        made.append((label, " ".join("".join(w) for w in letters[draw.integers(len(letters), size=(words, 9))])))
    return made


@pytest.fixture(scope="module")
def model():
    sample = texts_of(30, 60)
    return language.train([t for _, t in sample], [x for x, _ in sample])


def test_memory_of_new_words(model):
    """What is held besides the cache does not grow with the new words of a slice of documents."""
    texts = [t for _, t in texts_of(1024, 100)]
    tagger = language.Tagger(model)
    tracemalloc.start()
    try:
        tagger.documents(texts)
        held, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(tagger.known) > 100_000
    assert peak - held < 40e6


def test_slices_give_the_shares_of_single_texts(model):
    rows = texts_of(259, 20)
    texts = [t for _, t in rows] + ["", None, "1 2", rows[0][1] * 40]
    shares = language.Tagger(model).documents(texts)
    alone = np.concatenate([language.Tagger(model).documents([t]) for t in texts])
    assert np.allclose(shares, alone, atol=1e-5)
    assert not shares[len(rows) : len(rows) + 3].any()


def test_kept_text_goes_to_python_once(spark, model):
    rows = [(d, t, x) for d, (x, t) in enumerate(texts_of(9, 30))] + [(None, None, None), (3, "", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.identify_language(docs, model, keep=["lang", "text"])
    assert found.columns == ["doc_id", "lang", "text", "lang_pred", "score", "shares"]
    assert "_text" not in found._jdf.queryExecution().analyzed().toString()
    plain = language.identify_language(docs, model).collect()
    assert [(r["doc_id"], r["text"], r["lang"]) for r in found.collect()] == rows
    assert [r[:1] + r[3:] for r in found.collect()] == [tuple(r) for r in plain]
