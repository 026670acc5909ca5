"""Quality rules as a short-circuit cascade ordered by rejections per cost."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rategrid.llm.storage import stage
from rategrid.llm.text import fold, gram_hashes, let, lines, whole, words

SYMBOLS = "[#*$%&|<>]"
REPEAT_WORDS = 5
SAMPLE = 2000  # rows that costs and rejections are measured on
FILES, RUNS = 4, 2  # files of the sample, timed passes over it


@dataclass(frozen=True)
class Rule:
    """A named rule; ``fails`` is computed from the column that holds the words and the one that holds the text."""

    name: str
    fails: Column


def n_symbols(text: str) -> Column:
    whole_text = whole(text)
    return (F.char_length(whole_text) - F.char_length(F.regexp_replace(whole_text, SYMBOLS, ""))).cast("long")


def word_chars(tokens: str) -> Column:
    return F.char_length(F.array_join(F.col(tokens), "")).cast("long")


def n_dup_lines(text: str) -> Column:
    """Lines with a word that equal an earlier line."""
    full = F.filter(lines(whole(text)), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    return let(full, lambda f: F.size(f) - F.size(F.array_distinct(f))).cast("long")


def repeated_starts(grams: Column) -> Column:
    """Ascending positions of hashes that occur twice or more: neighbours after sorting by hash."""

    def marked(ordered: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            before, after = F.get(ordered, i - 1)["h"], F.get(ordered, i + 1)["h"]
            return F.when((x["h"] == before) | (x["h"] == after), x["i"])

        return F.sort_array(F.array_compact(F.transform(ordered, twin)))

    rows = F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return let(F.array_sort(rows), marked)


def covered(starts: Column, width: int) -> Column:
    """Number of positions in runs of ``width`` from ascending ``starts``."""

    def total(s: Column) -> Column:
        steps = fold(s, s, 1, lambda a, b: F.least(b - a, F.lit(width)))
        most = F.aggregate(steps, F.lit(0).cast("long"), lambda t, x: t + x) + width
        return F.when(F.size(s) > 0, most).otherwise(F.lit(0).cast("long"))

    return let(starts, total)


def repeat_words(grams: Column) -> Column:
    """Words in windows found twice or more; texts without a repeated window are not sorted."""

    def count(h: Column) -> Column:
        plain = F.size(F.array_distinct(h)) == F.size(h)
        return F.when(plain, F.lit(0).cast("long")).otherwise(covered(repeated_starts(h), REPEAT_WORDS))

    return let(grams, count)


def base_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics that the rules use, one row per input row.  Null text: no words, one line without a word."""
    tokens = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), words(whole(text)).alias("words"))
    grams = tokens.withColumn("grams", gram_hashes(F.col("words"), REPEAT_WORDS))
    return grams.select(
        "doc_id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        word_chars("words").alias("word_chars"),
        n_symbols("text").alias("n_symbols"),
        n_dup_lines("text").alias("n_dup_lines"),
        repeat_words(F.col("grams")).alias("n_repeat_words"),
    )


def standard_rules() -> list[Rule]:
    """Rules on the columns of :func:`base_columns`; each rejects a kind of junk that prose never reaches."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return [
        Rule("short", n < 10),
        Rule("repeats", F.col("n_repeat_words") * 100 > n * 20),
        Rule("symbols", F.col("n_symbols") > n),
        Rule("word_length", (chars > n * 20) | (chars < n * 2)),
        Rule("dup_lines", F.col("n_dup_lines") * 2 > F.size(lines(whole("text")))),
    ]


def raw_rules(text: str = "text") -> list[Rule]:
    """The same rules from the text alone, each with only the work it needs; these are what a cascade saves."""
    tokens = words(whole(text))
    n = F.size(tokens).cast("long")
    repeats = let(tokens, lambda t: repeat_words(gram_hashes(t, REPEAT_WORDS)) * 100 > F.size(t) * 20)
    odd = let(tokens, lambda t: let(F.char_length(F.array_join(t, "")), lambda c: (c > F.size(t) * 20) | (c < F.size(t) * 2)))
    symbols = let(tokens, lambda t: n_symbols(text) > F.size(t))
    return [
        Rule("short", n < 10),
        Rule("repeats", repeats),
        Rule("symbols", symbols),
        Rule("word_length", odd),
        Rule("dup_lines", n_dup_lines(text) * 2 > F.size(lines(whole(text)))),
    ]


@dataclass(frozen=True)
class Measured:
    name: str
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def measure(sample: DataFrame, rules: Sequence[Rule], runs: int = RUNS) -> list[Measured]:
    """Seconds and share of rejected rows of each rule over ``sample``, which must be cheap to read again.

    A pass that only reads the column is timed too and taken off, so that seconds are the rule's own.  Passes go round
    ``runs`` times, the first to compile; of the others the shortest counts.
    """
    reads = F.octet_length(F.col(sample.columns[0]).cast("string")) < 0
    passes = [("", reads), *[(rule.name, F.coalesce(rule.fails, F.lit(False))) for rule in rules]]
    total = max(sample.count(), 1)
    seconds: dict[str, list[float]] = {}
    bad: dict[str, int] = {}
    for _ in range(runs + 1):
        for name, fails in passes:
            start = time.perf_counter()
            bad[name] = sample.filter(fails).count()
            seconds.setdefault(name, []).append(time.perf_counter() - start)
    least = {name: min(s[1:]) for name, s in seconds.items()}
    return [Measured(r.name, max(least[r.name] - least[""], 0.0), bad[r.name] / total) for r in rules]


def ordered_rules(sample: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    """Rules by rejections per second on the sample, ties by name.  The order never changes which rows pass."""
    worth = {m.name: m.worth for m in measure(sample, rules)}
    return sorted(rules, key=lambda r: (-worth[r.name], r.name))


def cascade(rules: Sequence[Rule]) -> Column:
    """Verdict that stops at the first failing rule: true where no rule fails."""
    verdict = F.lit(True)
    for rule in reversed(rules):
        verdict = F.when(F.coalesce(rule.fails, F.lit(False)), F.lit(False)).otherwise(verdict)
    return verdict


def sample_rows(docs: DataFrame, rows: int = SAMPLE, seed: int = 11) -> DataFrame:
    """About ``rows`` rows from all over ``docs``, written once in a few files.  It only serves to order rules."""
    share = min(1.0, rows / max(docs.count(), 1))
    return stage(docs.sample(fraction=share, seed=seed).repartition(FILES), "rule-sample")


def filter_quality(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Rows of ``docs`` that pass every rule, rules ordered on a sample of about ``sample`` rows.

    Nothing but the text is read by the rules; null and empty texts fail the ``short`` rule.  All columns return as they
    are, whatever their names.
    """
    rules = ordered_rules(sample_rows(docs.select(text), sample), raw_rules(text))
    return docs.filter(cascade(rules))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, the statistics, ``base_failed`` and ``kept`` for every input row.

    The cascade runs over the statistics, in the order measured on the sample.  ``base_failed`` holds for fewer than
    ten words or more than a fifth of words in repeated windows; then ``kept`` is false.
    """
    stats = base_columns(docs, doc_id, text)
    order = [r.name for r in ordered_rules(sample_rows(docs.select(text), sample), raw_rules(text))]
    rules = sorted(standard_rules(), key=lambda r: order.index(r.name))
    n = F.col("n_words")
    failed = (n < 10) | (F.col("n_repeat_words") * 100 > n * 20)
    out = stats.withColumn("base_failed", failed).withColumn("kept", ~failed & cascade(rules))
    return out.drop("text")
