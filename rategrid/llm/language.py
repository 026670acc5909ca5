"""Language of code-switched text by a linear-chain conditional random field.

Every word gets a label.  Affixes, character n-grams and per-language lexicons score a word, learned transitions tie
neighbours, and forward-backward gives each word's label distribution; a document's scores are their mean.

The model is fitted on a bounded sample of labelled rows (:data:`TRAIN_DOCS` texts and :data:`TRAIN_WORDS` words per label).  Documents have one label each,
so training sequences are spliced from segments of several documents: that is where switches are learned from.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rategrid.llm.hashing import give_back

TRAIN_DOCS = 400  # labelled rows per label in the sample
TRAIN_WORDS = 120_000  # words per label that training sequences are spliced from, shared evenly by its texts
FEATURES = 1 << 16
LEXICON = 1000  # most frequent words per label that get a feature of their own
SEGMENT = 24  # mean words between switches in training sequences
LENGTH, BATCH, EPOCHS = 64, 128, 3
UNKNOWN = "und"
CACHE = 400_000
SPLIT_DOCS = 128  # documents whose pieces are held as strings at once
LEARN = 8192  # new pieces whose features are held at once
CELLS = 1 << 20  # words times labels of a batch of documents
_LETTERS = re.compile(r"[^\W\d_]+")
_N = 3


def letters(piece: str) -> str:
    """The letters of a piece between blanks, in lower case; apostrophes and signs fall away."""
    return "".join(_LETTERS.findall(piece)).lower()


def word_features(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words in a row and where each word's begin.

    A word is padded on both sides; all its 1- to 4-grams are taken by one rolling hash.  Grams that touch a border are
    its affixes.  One more feature names the word as a whole, for the lexicon.
    """
    padded = [f"\x02{w}\x03" for w in words]
    sizes = np.array([len(p) for p in padded], dtype=np.int64)
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(padded)), sizes)
    ends = np.cumsum(sizes)[word]
    place = np.arange(len(codes))
    made, owner = [], []
    h = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, _N + 2):
        shifted = np.zeros(len(codes), dtype=np.uint64)
        shifted[: len(codes) - n + 1] = codes[n - 1 :]
        h = (h * np.uint64(0x100000001B3) + shifted + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n == 1:
            continue
        whole = place + n <= ends
        made.append(h[whole])
        owner.append(word[whole])
    feature = np.concatenate(made) & np.uint64(FEATURES - 1)
    order = np.argsort(np.concatenate(owner), kind="stable")
    starts = np.searchsorted(np.concatenate(owner)[order], np.arange(len(padded)))
    return feature[order].astype(np.int64), starts


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (FEATURES, labels)
    lexicon: dict[str, np.ndarray]  # word -> score per label
    moves: np.ndarray  # log transition scores
    first: np.ndarray

    def emissions(self, words: Sequence[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.labels)))
        features, starts = word_features(words)
        sizes = np.diff(np.append(starts, len(features)))
        out = np.add.reduceat(self.weights[features], starts, axis=0) / np.sqrt(sizes)[:, None]
        for i, w in enumerate(words):
            if (extra := self.lexicon.get(w)) is not None:
                out[i] += extra
        return out


def forward_backward(scores: np.ndarray, moves: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label distributions of every position, and expected counts of label pairs.

    ``scores`` is (time, sequences, labels), log scale; ``sizes`` are the true lengths.  Messages are scaled in every step.
    """
    steps, rows, k = scores.shape
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    step = np.exp(moves - moves.max())
    alpha = np.empty_like(local)
    now = local[0] * np.exp(first - first.max())
    alpha[0] = now / now.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        now = (alpha[t - 1] @ step) * local[t]
        alpha[t] = now / now.sum(axis=1, keepdims=True)
    pairs = np.zeros((k, k))
    post = np.empty_like(local)
    beta = np.ones((rows, k))
    back = step.T
    for t in range(steps - 1, -1, -1):
        beta[sizes - 1 == t] = 1.0
        joint = alpha[t] * beta
        post[t] = joint / joint.sum(axis=1, keepdims=True)
        if t:
            seen = local[t] * beta
            live = sizes > t
            if live.any():
                a, b = alpha[t - 1][live], seen[live]
                scale = np.einsum("ri,ij,rj->r", a, step, b)
                pairs += (a / scale[:, None]).T @ b * step
            beta = seen @ back
            beta /= beta.sum(axis=1, keepdims=True)
    return post, pairs


def _posteriors(scores: np.ndarray, moves: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Label distributions only, for prediction: the same recursions without pair counts.  ``scores`` is overwritten."""
    steps = len(scores)
    local = scores
    local -= local.max(axis=2, keepdims=True)
    np.exp(local, out=local)
    step = np.exp(moves - moves.max())
    alpha = np.empty_like(local)
    now = local[0] * np.exp(first - first.max())
    alpha[0] = now / now.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        now = (alpha[t - 1] @ step) * local[t]
        now /= now.sum(axis=1, keepdims=True)
        alpha[t] = now
    beta = np.ones_like(alpha[0])
    back = step.T
    ends = np.bincount(sizes - 1, minlength=steps)
    for t in range(steps - 1, -1, -1):
        if ends[t]:
            beta[sizes - 1 == t] = 1.0
        alpha[t] *= beta
        beta = (local[t] * beta) @ back
        beta /= beta.sum(axis=1, keepdims=True)
    alpha /= alpha.sum(axis=2, keepdims=True)
    return alpha


def _shared_pool(texts: Sequence[list[str]], most: int, rng: np.random.Generator) -> list[str]:
    """At most ``most`` words in a row, every text with an equal share: short ones whole, of longer ones a random span."""
    if sum(map(len, texts)) <= most:
        return [w for words in texts for w in words]
    left, share = most, 0
    for done, size in enumerate(sorted(map(len, texts))):
        share = left // (len(texts) - done)
        if size > share:
            break
        left -= size
    pool: list[str] = []
    for words in texts:
        at = int(rng.integers(max(len(words) - share, 0) + 1))
        pool.extend(words[at : at + share])
    return pool


def train(texts: Sequence[str], labels: Sequence[str], seed: int = 5) -> Model:
    """Fit on labelled texts by stochastic gradient ascent of the conditional likelihood."""
    names = sorted(set(labels))
    if not names:
        return Model([], np.zeros((FEATURES, 0)), {}, np.zeros((0, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    pools: list[list[list[str]]] = [[] for _ in names]
    counts = [Counter() for _ in names]
    for text, label in zip(texts, labels, strict=True):
        at = names.index(label)
        words = [w for w in map(letters, (text or "").split()) if w]
        counts[at].update(words)
        pools[at].append(words)
    pools = [_shared_pool(texts_of, TRAIN_WORDS, rng) for texts_of in pools]
    k = len(names)
    lexicon: dict[str, np.ndarray] = {}
    for c in counts:
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(w, np.zeros(k))
    model = Model(names, np.zeros((FEATURES, k)), lexicon, np.zeros((k, k)), np.zeros(k))
    pools = [p if p else [""] for p in pools]
    distinct = sorted({w for p in pools for w in p})
    index = {w: i for i, w in enumerate(distinct)}
    coded = [np.array([index[w] for w in p]) for p in pools]
    features, starts = word_features(distinct)
    bounds = np.append(starts, len(features))
    named = np.array([w in lexicon for w in distinct])
    slots = {w: i for i, w in enumerate(w for w in distinct if w in lexicon)}
    lex = np.zeros((len(slots), k))
    slot_of = np.array([slots.get(w, -1) for w in distinct])
    total = sum(map(len, coded))
    rounds = max(1, EPOCHS * total // (LENGTH * BATCH))
    moves, first, weights = model.moves, model.first, model.weights
    g_w, g_l, g_m, g_f = np.full_like(weights, 1e-6), np.full_like(lex, 1e-6), np.full_like(moves, 1e-6), np.full_like(first, 1e-6)
    rate = 0.5
    for _ in range(rounds):
        tags = np.empty((LENGTH, BATCH), dtype=np.int64)
        items = np.empty((LENGTH, BATCH), dtype=np.int64)
        for b in range(BATCH):  # splice segments; every label is as likely as any other
            t = 0
            while t < LENGTH:
                tag = int(rng.integers(k))
                size = min(int(rng.geometric(1 / SEGMENT)), LENGTH - t)
                at = int(rng.integers(len(coded[tag])))
                take = np.take(coded[tag], np.arange(at, at + size), mode="wrap")
                items[t : t + size, b], tags[t : t + size, b] = take, tag
                t += size
        used, where = np.unique(items, return_inverse=True)
        where = where.reshape(items.shape)
        sizes = bounds[used + 1] - bounds[used]
        flat = np.repeat(bounds[used] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        rows = features[flat]
        norm = 1 / np.sqrt(sizes)
        score = np.add.reduceat(weights[rows], np.cumsum(sizes) - sizes, axis=0) * norm[:, None]
        known = named[used]
        score[known] += lex[slot_of[used[known]]]
        post, pairs = forward_backward(score[where], moves, first, np.full(BATCH, LENGTH))
        gold = np.zeros_like(post)
        np.put_along_axis(gold, tags[:, :, None], 1.0, axis=2)
        error = gold - post
        per_word = np.stack([np.bincount(where.ravel(), error[:, :, j].ravel(), minlength=len(used)) for j in range(k)], axis=1)
        spread = np.repeat(per_word * norm[:, None], sizes, axis=0)
        grad = np.stack([np.bincount(rows, spread[:, j], minlength=FEATURES) for j in range(k)], axis=1) / BATCH
        g_w += grad**2
        weights += rate * grad / np.sqrt(g_w)
        at = slot_of[used[known]]
        step = per_word[known] / BATCH
        g_l[at] += step**2
        lex[at] += rate * step / np.sqrt(g_l[at])
        seen = np.zeros((k, k))
        np.add.at(seen, (tags[:-1].ravel(), tags[1:].ravel()), 1.0)
        step = (seen - pairs) / BATCH
        g_m += step**2
        moves += rate * step / np.sqrt(g_m)
        step = error[0].sum(axis=0) / BATCH
        g_f += step**2
        first += rate * step / np.sqrt(g_f)
    for w, i in slots.items():
        lexicon[w] = lex[i]
    return model


class Tagger:
    """Word distributions of many documents; scores of pieces between blanks are cached."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.labels)), dtype=np.float32)
        self.used = 0

    def learn(self, pieces: list[str]) -> None:
        plain = [letters(p) for p in pieces]
        real = [w for w in plain if w]
        scores = self.model.emissions(real)
        need = self.used + len(real)
        if need > len(self.table):
            grown = np.zeros((max(need, 2 * len(self.table)), self.table.shape[1]), dtype=np.float32)
            grown[: self.used] = self.table[: self.used]
            self.table = grown
        self.table[self.used : need] = scores
        at = self.used
        for piece, word in zip(pieces, plain, strict=True):
            self.known[piece] = at if word else -1
            at += bool(word)
        self.used = need

    def documents(self, texts: Sequence[str | None]) -> np.ndarray:
        """Mean label distribution per document; zeros where there is no letter."""
        if len(self.known) > CACHE:
            self.reset()
        known = self.known
        coded = []
        for at in range(0, len(texts), SPLIT_DOCS):
            split = [(t or "").split() for t in texts[at : at + SPLIT_DOCS]]
            new = list({p for pieces in split for p in pieces if p not in known})
            for lo in range(0, len(new), LEARN):
                self.learn(new[lo : lo + LEARN])
            for pieces in split:
                ids = np.fromiter(map(known.__getitem__, pieces), dtype=np.int32, count=len(pieces))
                coded.append(ids[ids >= 0])
        k = len(self.model.labels)
        out = np.zeros((len(texts), k))
        sizes = np.array([len(c) for c in coded])
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        at = 0
        while at < len(order):  # documents of like length share a batch
            low = sizes[order[at]]
            to = int(np.searchsorted(sizes[order], low * 1.3 + 8, side="right"))
            to = max(min(to, at + max(1, CELLS // k // int(sizes[order[min(to, len(order)) - 1]]))), at + 1)
            some = order[at:to]
            steps = int(sizes[some[-1]])
            ids = np.zeros((steps, len(some)), dtype=np.int32)
            for j, d in enumerate(some):
                ids[: sizes[d], j] = coded[d]
            post = _posteriors(self.table[ids], self.model.moves.astype(np.float32), self.model.first.astype(np.float32), sizes[some])
            live = np.arange(steps)[:, None] < sizes[some][None, :]
            post *= live[:, :, None]
            out[some] = post.sum(axis=0) / sizes[some][:, None]
            at = to
        return out


def _tagging(model: Model, at_text: int, passed: bool):
    """Rows with their language beside them; column ``at_text`` is the text, which stays if ``passed``."""
    labels = [*model.labels, UNKNOWN]
    k = len(model.labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            kept = [i for i in range(batch.num_columns) if passed or i != at_text]
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                shares = tagger.documents(part.column(at_text).to_pylist()) if k else np.zeros((part.num_rows, 1))
                found = shares.sum(axis=1) > 0
                best = np.where(found, shares.argmax(axis=1), k)
                made = [
                    pa.array([labels[i] for i in best], pa.string()),
                    pa.array(np.clip(shares.max(axis=1), 0.0, 1.0), pa.float64()),
                    pa.array([list(x[:k]) for x in shares], pa.list_(pa.float64())),
                ]
                names = [*(part.schema.names[i] for i in kept), "lang_pred", "score", "shares"]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *made], names=names)
        del tagger
        give_back()

    return run


def training_sample(docs: DataFrame, label: str = "lang", text: str = "text", most: int = TRAIN_DOCS) -> list[tuple[str, str]]:
    """``most`` distinct labelled texts per label (all if fewer), those with the lowest hashes in the whole table.

    Equal texts of one label count once, so copies neither crowd out other texts nor cost a label its place.  Rows per
    label are cut to ``most`` hashes on each side of the shuffle; only texts at or below a label's last hash are read.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(label).alias("label")).filter("label is not null and text is not null")
    hashed = rows.withColumn("h", F.xxhash64("text", F.lit(17)))
    lowest = Window.partitionBy("label").orderBy("h")
    distinct = hashed.groupBy("label", "h").agg(F.lit(1).alias("one")).withColumn("at", F.row_number().over(lowest))
    last = {r["label"]: r["h"] for r in distinct.filter(F.col("at") <= most).groupBy("label").agg(F.max("h").alias("h")).collect()}
    if not last:
        return []
    bound = F.lit(None).cast("long")
    for name, h in sorted(last.items()):
        bound = F.when(F.col("label") == name, F.lit(h).cast("long")).otherwise(bound)
    drawn = hashed.filter(F.col("h") <= bound).groupBy("label", "h").agg(F.min("text").alias("text"))
    return sorted((r["label"], r["text"]) for r in drawn.collect())


def fit_language(docs: DataFrame, label: str = "lang", text: str = "text") -> Model:
    sample = training_sample(docs, label, text)
    model = train([t for _, t in sample], [x for x, _ in sample])
    del sample
    give_back()  # the driver goes on with other operators
    return model


def identify_language(
    docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """``doc_id, lang_pred, score, shares`` for every input row; ``shares`` follow ``model.labels``.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if the model knows no label.
    Repeated rows and null ids return as they come; ties go to the first label in order.  Columns named in ``keep``
    pass through beside the result; a text among them goes to a Python worker once.
    """
    columns = [F.col(doc_id).alias("doc_id"), *[F.col(c) for c in keep]]
    passed = text in keep
    at_text = 1 + list(keep).index(text) if passed else len(columns)
    rows = docs.select(*columns, *([] if passed else [F.col(text).alias("_text")]))
    schema = T.StructType(
        [
            *rows.schema.fields[: len(columns)],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("shares", T.ArrayType(T.DoubleType())),
        ]
    )
    return rows.mapInArrow(_tagging(model, at_text, passed), schema)


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of ids that is never learned from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0
