"""Benchmark decontamination by winnowing.

Of every window of ``WINDOW`` words the smallest ``GRAM``-gram hash is kept.  A window shared by a document and an item
keeps the same hash on both sides, so joining kept hashes finds every shared window; each hit is then extended to the
ten words around it and compared word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rategrid.llm.storage import stage
from rategrid.llm.text import ascii_lower, digest, gram_hashes, let, sliding_least, whole, words

GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW = 10
GRAM = 4


def plain_words(text: str | Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A-Z in lower case."""
    return words(ascii_lower(whole(text)), GAP)


def fingerprints(tokens: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """Kept hashes of a document, each once; none if it has no full window."""
    return let(gram_hashes(tokens, gram), lambda h: F.array_distinct(sliding_least(h, window - gram + 1)))


def item_windows(items: DataFrame, item_id: str, text: str, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows of all items, and which item has which.

    The first: ``g1, g2`` (digest), ``span`` (the words), ``size``, ``f`` (its kept hash) and ``o`` (the first place of
    that hash).  Items shorter than ``window`` are one window; ``f`` is then the hash of the whole of it and ``o`` 0.
    """
    tokens = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), plain_words(text).alias("w"))
    tokens = tokens.filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    rows = tokens.select("item", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s, size))).alias("span"))
    g1, g2 = digest(F.array_join("span", " "))
    rows = stage(rows.select("item", "span", g1.alias("g1"), g2.alias("g2")).distinct(), "item-windows")
    spans = rows.groupBy("g1", "g2").agg(F.first("span").alias("span")).withColumn("size", F.size("span"))
    full = spans.filter(F.col("size") == window).withColumn("h", gram_hashes(F.col("span"), gram))
    full = full.withColumn("f", F.array_min("h")).withColumn("o", (F.array_position("h", F.col("f")) - 1).cast("int")).drop("h")
    parts = [full]
    for n in range(1, window):
        short = spans.filter(F.col("size") == n)
        parts.append(short.withColumn("f", F.get(gram_hashes(F.col("span"), n), F.lit(0))).withColumn("o", F.lit(0)))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return stage(found, "windows"), rows.select("item", "g1", "g2")


def _seed_rows(tokens: DataFrame, hashes: Column, before: int, after: int) -> DataFrame:
    """``doc_id, mark, f, p, ctx, lead``: wanted places with the words from ``before`` ahead to ``after`` behind."""
    places = F.filter(
        F.transform(hashes, lambda x, i: F.struct(x.alias("f"), i.alias("p"))),
        lambda x: F.array_contains(F.col("wanted"), x["f"]),
    )
    rows = tokens.select("doc_id", "mark", "w", F.explode(places).alias("x"))
    lead = F.least(F.col("x.p"), F.lit(before))
    ctx = F.slice("w", F.col("x.p") - lead + 1, lead + after)
    return rows.select("doc_id", "mark", F.col("x.f").alias("f"), F.col("x.p").alias("p"), ctx.alias("ctx"), lead.alias("lead"))


def _hits(base: DataFrame, windows: DataFrame, kept: Column, every: Column, before: int, after: int) -> DataFrame:
    """Places where a window occurs: ``doc_id, mark, at, size, g1, g2``.

    ``kept`` are a document's hashes that enter the join, ``every`` the hashes of all its places.
    """
    names = windows.select("f").distinct()
    rows = base.select("doc_id", "mark", F.explode(kept).alias("f")).join(names, "f")
    wanted = (
        rows.groupBy("doc_id", "mark")
        .agg(F.collect_set("f").alias("wanted"))
        .select(F.col("doc_id").alias("w_id"), F.col("mark").alias("w_mark"), "wanted")
    )
    wanted = stage(wanted, "seeded-documents")
    on = base["doc_id"].eqNullSafe(wanted["w_id"]) & (base["mark"] == wanted["w_mark"])
    tokens = base.join(wanted, on).select("doc_id", "mark", "w", "wanted")
    seeds = _seed_rows(tokens, every, before, after)
    met = seeds.join(windows, "f")
    start = F.col("lead") - F.col("o")
    same = (start >= 0) & (F.slice("ctx", F.greatest(start, F.lit(0)) + 1, F.col("size")) == F.col("span"))
    return met.filter(same).select("doc_id", "mark", (F.col("p") - F.col("o")).alias("at"), "size", "g1", "g2")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
) -> DataFrame:
    """Words of each document inside occurrences of item windows: ``doc_id, n_words, n_hit, n_items, items``.

    ``items`` lists the ids as sorted strings (a null id as an empty one).  Items without words have no window.  Null
    text has no words; repeated rows all return; repeated items count once; a null doc_id keeps its row.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    base = plain.select("doc_id", "mark", plain_words("text").alias("w"))
    windows, owners = item_windows(items, item_id, item_text, window, gram)
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most `window` numbers
    parts = []
    for n in sizes:
        some = windows.filter(F.col("size") == n)
        if n == window:
            every = gram_hashes(F.col("w"), gram)
            parts.append(_hits(base, some, fingerprints(F.col("w"), window, gram), every, window - gram, window))
        else:
            grams = gram_hashes(F.col("w"), n)
            parts.append(_hits(base, some, F.array_distinct(grams), grams, 0, n))
    counted = plain.select("doc_id", "mark", F.size(plain_words("text")).cast("long").alias("n_words"))
    if not parts:
        none = F.array().cast("array<string>")
        return counted.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("items"))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    hits = stage(hits, "benchmark-hits")
    inside = F.transform("places", lambda x: F.sequence(x["at"], x["at"] + x["size"] - 1))
    covered = (
        hits.groupBy("doc_id", "mark")
        .agg(F.collect_set(F.struct("at", "size")).alias("places"))
        .select(F.col("doc_id").alias("c_id"), F.col("mark").alias("c_mark"), F.size(F.array_distinct(F.flatten(inside))).cast("long").alias("n_hit"))
    )
    listed = (
        hits.select("doc_id", "mark", "g1", "g2").distinct().join(owners, ["g1", "g2"])
        .groupBy("doc_id", "mark")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .select(F.col("doc_id").alias("l_id"), F.col("mark").alias("l_mark"), "items")
    )
    out = counted.join(covered, counted["doc_id"].eqNullSafe(covered["c_id"]) & (counted["mark"] == covered["c_mark"]), "left")
    out = out.join(listed, out["doc_id"].eqNullSafe(listed["l_id"]) & (out["mark"] == listed["l_mark"]), "left")
    found = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        found.alias("items"),
    )
