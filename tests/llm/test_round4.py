"""Packing and near duplicates after the findings of round 3."""

from __future__ import annotations

import numpy as np

from rategrid.llm import packing


def _bm25(ids, weight, mean, seed, unused):
    total = np.zeros(len(ids))
    for d, own in enumerate(ids):
        for term, count in zip(*np.unique(own, return_counts=True), strict=True):
            if unused[d] and term in ids[seed]:
                norm = packing.K1 * (1 - packing.B + packing.B * len(own) / mean)
                total[d] += weight[term] * count * (packing.K1 + 1) / (count + norm)
    return total


def test_scores_after_documents_are_used():
    """Used documents leave the index, whose frequent and rare terms give the scores of all others as before."""
    draw = np.random.default_rng(3)
    ids = [draw.zipf(1.3, 40) % 200 for _ in range(60)]
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=200)
    weight, mean = np.log1p((60 - df + 0.5) / (df + 0.5)), 40.0
    index = packing.Shard(ids, weight, mean)
    assert 0 < len(index.rows) < np.count_nonzero(df)  # some terms are frequent, some rare
    unused = np.ones(60, dtype=bool)
    for seed in draw.permutation(60)[:55]:
        unused[seed] = False
        found = index.scores(int(seed), unused)
        assert np.allclose(found, _bm25(ids, weight, mean, seed, unused))
        assert index.neighbours(int(seed), unused).tolist() == sorted(np.flatnonzero(found > 0), key=lambda d: (-found[d], d))
    assert len(index.columns) < 10 and unused[index.doc].sum() >= 0.5 * len(index.doc)


def test_document_counts_of_repeated_ids():
    import pyarrow as pa

    bodies = [np.array(x, dtype="<u4").tobytes() for x in ([5, 5, 1], [70000, 5, 70000], [1])]
    rows = [pa.RecordBatch.from_arrays([pa.array(bodies, pa.binary())], names=["ids"])]
    made = next(packing._document_counts(np.dtype("<u4"))(iter(rows))).to_pylist()
    assert made == [{"token": 1, "df": 2}, {"token": 5, "df": 2}, {"token": 70000, "df": 1}]


def test_unlinked_members_of_a_passage_skip_wide_rounds(spark, monkeypatch):
    """Documents that share a passage and are not linked go to the exact last step after few hubs; links stay."""
    from rategrid.llm import neardup

    shared = [f"p{i}" for i in range(56)]
    texts = [(d, " ".join([*shared, *[f"w{d}x{i}" for i in range(16)]])) for d in range(40)]
    texts += [(100 + d, texts[d][1] + " more") for d in range(3)]
    breadths, before = [], neardup._hub_pairs
    monkeypatch.setattr(neardup, "_hub_pairs", lambda *a: breadths.append(a[-1]) or before(*a))
    rows = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {d: d % 100 for d, _ in texts}
    assert breadths[-1] <= neardup.FEW
