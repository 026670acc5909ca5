"""Tokenizer alignment, token counts and the prefix trie against plain Python, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from rategrid.llm import alignment, conversations, tokencounts
from rategrid.llm.queries import tokenizer

A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
ODD = [
    None,
    "",
    " ",
    " \n\t ",
    "a ▁ b",
    "don't 's\n's  it''s we'll I've'd they're 'REL 'lx 'l",
    "x" * 30_000,
    "9" * 20_000 + " \n  z",
    "été 中文 字 \U0001f600　é　 ok <s> <|endoftext|> </s><|endoftext|>",
    "tab\ttab \x00 \x1c nul",
    "a fine line " * 3000,
]


def documents(spark, rows):
    names = ["mark", "row", "same", "pairs", "n_a", "piece", "a", "best", "n_tokens"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType()) for c in names]])
    return spark.createDataFrame([(i, t, *["clash"] * len(names)) for i, t in rows], schema)


@pytest.fixture(scope="module")
def rows(spark):
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return [tuple(r) for r in some] + [(10**6 + i, t) for i, t in enumerate(ODD)] + [(None, "no id here"), (0, some[0]["text"])]


def groups_of(tool, text):
    """Groups by walking both token lists, None without tokens."""
    if not text:
        return None
    a, b = tool.a.encode(" " + text, add_special_tokens=False).ids, tool.b.encode(text)
    if any(b"".join(table[i] for i in ids) != (" " + text).encode() for table, ids in ((tool.bytes_a, a), (tool.bytes_b, b))):
        return None
    ends = [np.cumsum([len(table[i]) for i in ids]).tolist() for table, ids in ((tool.bytes_a, a), (tool.bytes_b, b))]
    out, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        i2, j2 = ends[0].index(cut) + 1, ends[1].index(cut) + 1
        out.append((a[i:i2], b[j:j2]))
        i, j = i2, j2
    return out


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 5])
def test_alignment(spark, rows, frequent):
    rows = [(i, t) for i, t in rows if not t or len(t) < 12_000]
    tool = alignment.aligner(A, B)
    found = [groups_of(tool, t) for _, t in rows]
    links = [[(x, y) for a, b in g for x in a for y in b] if g else [] for g in found]
    docs = Counter(p for x in links for p in set(x))
    best = defaultdict(int)
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    want = Counter()
    for (i, _), g, x in zip(rows, found, links, strict=True):
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g) if g else ""
        sizes = [sum(len(s[k]) for s in g) if g else 0 for k in (0, 1)]
        last = hashlib.sha256(told.encode()).hexdigest() if g else ""
        want[(i, *sizes, len(g or []), len(x), sum(docs[p] == best[p[0]] for p in x), sum(docs[p] for p in x), last)] += 1
    got = alignment.align_tokenizers(documents(spark, rows), A, B, frequent=frequent)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert alignment.align_tokenizers(documents(spark, []), A, B).collect() == []


def test_alignment_of_long_runs(spark):
    """One group per text at most a few tokens apart, and groups as text."""
    rows = list(enumerate(ODD))
    made = {r["doc_id"]: r for r in alignment.align_documents(documents(spark, rows), A, B).collect()}
    assert made[4]["n_a"] == 0 and made[4]["groups_sha256"] == "" and made[0]["n_groups"] == 0
    for i in (6, 7, 10):
        assert made[i]["n_groups"] == made[i]["groups"].count(";") + 1
        assert hashlib.sha256(made[i]["groups"].encode()).hexdigest() == made[i]["groups_sha256"]


@pytest.mark.parametrize("sample", [tokencounts.SAMPLE_DOCS, 1])
def test_token_counts(spark, rows, sample):
    tool = tokencounts.pre_tokens(A).tokenizer
    want = Counter()
    for i, t in rows:
        n = len(tool.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 1024)] += 1
    got = tokencounts.count_tokens(documents(spark, rows), A, sample=sample)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert tokencounts.count_tokens(documents(spark, []), A).collect() == []


def counted(texts, table):
    """Token counts of ``texts`` without Spark."""

    class Sent:
        value = table

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    return next(iter(tokencounts._counting(A, Sent)(iter([batch])))).column(2).to_pylist()


def test_cut_of_random_texts():
    tool = tokencounts.pre_tokens(A)
    generator = random.Random(3)
    signs = list("'strevlmd  \n\tab1!é 　\u0085½²٣ǅ字") + ["<|endoftext|>"]
    texts = ["".join(generator.choice(signs) for _ in range(generator.randint(0, 60))) for _ in range(5000)]
    want = [len(tool.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    pieces = [b" ", b"'s", b"tr", b" a", b"\xe5\xad\x97"]
    assert counted(texts, tokencounts.LengthTable([], [])) == want
    assert counted(texts, tokencounts.LengthTable(pieces, tool.tokens(pieces), bits=5)) == want


def test_class_of_every_tenth_character():
    tool = tokencounts.pre_tokens(A)
    texts = [f"a{chr(p)}1{chr(p)} {chr(p)}'s" for p in range(0, 0x110000, 10) if not 0xD800 <= p < 0xE000]
    want = [len(x.ids) for x in tool.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert counted(texts, tokencounts.LengthTable([], [])) == want


def test_full_table_finds_every_key():
    generator = random.Random(5)
    pieces = list({bytes(generator.randrange(256) for _ in range(generator.randint(1, 15))) for _ in range(200)})
    table = tokencounts.LengthTable(pieces, [1 + i % 15 for i in range(len(pieces))], bits=8)
    data = np.frombuffer(b"".join(pieces) + b"absent", dtype=np.uint8)
    ends = np.append(np.cumsum([len(p) for p in pieces]), len(data))
    starts = np.append(0, ends[:-1])
    assert table.find(*tokencounts.keys(data, starts, ends)).tolist()[:-1] == [1 + i % 15 for i in range(len(pieces))]


def trie_of(rows):
    """The contract's nodes, from dictionaries of prefixes."""
    order = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            order[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in order.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:h] + said[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids, saved, leaves = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        words = len([w for w in __import__("re").split("[\x20\x09-\x0d]+", p[-1][1]) if w]) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * words
            leaves[p[:d]] += not kids[p]
    told = {p: ",".join(map(str, sorted(ends[p]))) if p in ends else "" for p in members}
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(told[p].encode()).hexdigest())
        for p, m in members.items()
    )


def turns(spark, rows):
    names = ["pos", "part", "block", "depth", "k1", "words", "chain", "x"]
    fields = [("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType())]
    schema = T.StructType([T.StructField(n, t) for n, t in [*fields, *[(n, T.StringType()) for n in names]]])
    return spark.createDataFrame([(*r, *["clash"] * len(names)) for r in rows], schema)


def nodes(frame):
    return Counter(tuple(r) for r in conversations.prefix_trie(conversations.spliced(frame)).select(*conversations.DIGEST).collect())


@pytest.mark.parametrize("height, block, bits", [(2, 3, 1), (conversations.BAND, conversations.BLOCK, conversations.ID_BITS)])
def test_trie(spark, monkeypatch, height, block, bits):
    monkeypatch.setattr(conversations, "BLOCK", block)
    monkeypatch.setattr(conversations, "ID_BITS", bits)
    monkeypatch.setattr(conversations.prefix_trie, "__defaults__", (height,))
    generator = random.Random(height)
    said = ["a b", "a  b c\n", "", None, "d"]
    rows = []
    for c in [*range(0, 20), *range(21, 40), 45, 60, 61]:  # conversations 20 and 40 are absent
        for t in range(generator.choice([1, 2, 3, 6, 17])):
            rows.append((c, None if t == 0 and c % 3 == 0 else t, generator.choice(["user", None]), generator.choice(said[: 2 + c % 4])))
    rows += [(100 + c, t, "user", "one very common conversation") for c in range(25) for t in range(9)]  # many equal ones
    rows += [(None, 1, "user", "nobody's"), (7, 50, "user", "twice"), (7, 50, "user", "twice")]
    generator.shuffle(rows)
    assert nodes(turns(spark, rows)) == trie_of(rows)


def test_trie_of_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 64)
    rows = [(5, t, "user", f"turn {t}") for t in range(700)] + [(6, t, "user", f"turn {t}") for t in range(650)]
    assert nodes(turns(spark, rows)) == trie_of(rows)


def test_empty_and_turnless(spark):
    assert nodes(turns(spark, [])) == Counter()
    rows = [(3, 0, "user", "gone")]  # takes turns of conversation 0, which is absent, and leaves out its own
    assert nodes(turns(spark, rows)) == trie_of(rows)
