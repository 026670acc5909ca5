"""Information-theoretic sanitisation of personal data.

Plain patterns find protected entities.  The corpus then says how much a term near an entity gives away about it: with
document counts, the share of the entity's information that the term carries is

    PMI(entity; term) / IC(entity)  =  1 - log(df(term) / co(entity, term)) / log(N / df(entity))

(1 if the term never appears without the entity; C-sanitisation of Sanchez and Batet).  Terms above thresholds are
generalised or removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rategrid.llm.storage import stage
from rategrid.llm.text import MATCHES, SPAN, ascii_lower, matches, spans_of, whole

# Entity patterns by kind in listed order.  Lookbehinds and possessive repeats find the same matches as
# the plain patterns without rescanning or recursion on very long runs.
PATTERNS = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
TERM = "\\p{L}{4,}"
REACH = 60  # code points on either side of an entity that count as its context
REMOVE_SHARE = 0.9
GENERALISE_SHARE = 0.6
LEAST_DOCS = 2  # documents in which a term and an entity must meet


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where the digit text passes the Luhn sum."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def _at_most_255(part: Column) -> Column:
    """Compared as text, since a part may have any number of digits."""
    bare = F.regexp_replace(part, "^0+", "")
    return (F.char_length(bare) < 3) | ((F.char_length(bare) == 3) & (bare <= "255"))


def entity_matches(text: Column) -> dict[str, Column]:
    """Matches by kind; failing ones are dropped without another try inside them."""
    found = {kind: matches(text, pattern) for kind, pattern in PATTERNS.items()}
    # a text without an @ holds no address, one without + no phone number
    none = F.array().cast(MATCHES)
    for kind, sign in (("email", "@"), ("phone", "+")):
        found[kind] = F.when(F.contains(text, F.lit(sign)), found[kind]).otherwise(none)
    found["ip"] = F.filter(found["ip"], lambda m: F.forall(F.split(m["value"], "\\."), _at_most_255))

    def card(m: Column) -> Column:
        d = _digits(m["value"])
        return F.when(F.char_length(d).between(12, 19), luhn(d)).otherwise(F.lit(False))

    found["card"] = F.filter(found["card"], card)
    found["phone"] = F.filter(found["phone"], lambda m: F.char_length(_digits(m["value"])).between(9, 15))
    return found


def _context(text: Column, entity: Column, before: bool) -> Column:
    """Terms beside an entity as (start, end, value), positions in the text; words cut by the border are left out."""
    if before:
        begin = F.greatest(entity["start"] - REACH, F.lit(0))
        part = F.substring(text, begin + 1, entity["start"] - begin)
        whole_word = lambda m: (m["start"] > 0) | (begin == 0)
    else:
        begin = entity["end"]
        part = F.substring(text, begin + 1, F.lit(REACH))
        whole_word = lambda m: (m["end"] < REACH) | (begin + REACH >= F.char_length(text))
    terms = F.filter(matches(part, TERM), whole_word)
    return F.transform(
        terms,
        lambda m: F.struct((m["start"] + begin).alias("start"), (m["end"] + begin).alias("end"), ascii_lower(m["value"]).alias("term")),
    )


def disclosure(entity_terms: DataFrame, docs: DataFrame) -> DataFrame:
    """Share of each entity's information that a term near it gives away: ``entity, term, share``.

    ``entity_terms`` has ``doc, entity, term`` (contexts), ``docs`` has ``text`` of the whole corpus.  Document counts of
    terms come from all documents; only terms that met an entity in ``LEAST_DOCS`` documents are counted.
    """
    once = entity_terms.select("doc", "entity", "term").distinct()
    co = once.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("co")).filter(F.col("co") >= LEAST_DOCS)
    co = stage(co, "pii-pairs")
    df_entity = once.select("doc", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("df_e"))
    # terms travel as hashes while they are counted
    wanted = stage(co.select(F.xxhash64("term").alias("t")).distinct(), "pii-terms")
    found = F.array_distinct(F.transform(F.regexp_extract_all(ascii_lower(whole("text")), F.lit(TERM), F.lit(0)), lambda w: F.xxhash64(w)))
    df_term = docs.select(F.explode(found).alias("t")).join(wanted, "t").groupBy("t").agg(F.count(F.lit(1)).alias("df_t"))
    total = docs.count()
    scored = co.withColumn("t", F.xxhash64("term")).join(df_term, "t").join(df_entity, "entity")
    information = F.log(F.lit(float(max(total, 1))) / F.col("df_e"))
    share = F.when(information > 0, 1.0 - F.log(F.col("df_t") / F.col("co")) / information).otherwise(F.lit(0.0))
    return scored.select("entity", "term", share.alias("share"))


def _named(kind: str) -> Column:
    """Matches of a kind as (start, end, entity); the entity is the matched text in lower case after its kind."""
    prefix = F.lit(f"{kind}:")
    return F.transform(
        F.col(kind),
        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.concat(prefix, F.lower(m["value"])).alias("entity")),
    )


def _replaced(kind: str) -> Column:
    label = F.lit(f"[{kind.upper()}]")
    return F.transform(F.col(kind), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), label.alias("with")))


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = GENERALISE_SHARE) -> DataFrame:
    """Entities and disclosing terms of every input row.

    Returns ``doc_id, text_hash``, one array of matches per kind and ``terms``: (start, end, term, share) of context
    terms whose share reaches ``threshold`` for an entity beside them.  Null text counts as empty, empty tables give
    none; repeated rows count as one document and all return; null ids keep their rows.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    body = whole("text")
    found = base.select("doc_id", "text", *[c.alias(k) for k, c in entity_matches(body).items()])
    entities = F.concat(*[_named(k) for k in KINDS])
    near = F.transform(
        entities,
        lambda e: F.struct(e["entity"].alias("entity"), F.concat(_context(body, e, True), _context(body, e, False)).alias("terms")),
    )
    staged = stage(
        found.select("doc_id", F.xxhash64("text").alias("text_hash"), *KINDS, near.alias("near")), "pii-entities"
    )
    rows = staged.select("doc_id", "text_hash", F.explode("near").alias("n")).select(
        "doc_id", "text_hash", "n.entity", F.explode("n.terms").alias("m")
    )
    beside = rows.select(F.struct("doc_id", "text_hash").alias("doc"), "entity", "m.start", "m.end", "m.term")
    scored = disclosure(beside, base).filter(F.col("share") >= threshold)
    marked = (
        beside.join(scored, ["entity", "term"])
        .groupBy("doc", "start", "end", "term")
        .agg(F.max("share").alias("share"))
        .groupBy("doc")
        .agg(F.collect_list(F.struct("start", "end", "term", "share")).alias("terms"))
        .select(F.col("doc.doc_id").alias("t_id"), F.col("doc.text_hash").alias("t_hash"), "terms")
    )
    on = staged["doc_id"].eqNullSafe(marked["t_id"]) & (staged["text_hash"] == marked["t_hash"])
    none = F.array().cast("array<struct<start:int,end:int,term:string,share:double>>")
    return staged.drop("near").join(marked, on, "left").select(
        "doc_id", "text_hash", *KINDS, F.coalesce(F.array_sort("terms"), none).alias("terms")
    )


def base_spans() -> Column:
    return F.concat(*[spans_of(F.col(k), k, i) for i, k in enumerate(KINDS)])


def all_spans() -> Column:
    """Entities and terms; a term inside an entity is part of it and left out."""
    free = F.filter(
        F.col("terms"),
        lambda t: ~F.exists(base_spans(), lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])),
    )
    terms = F.transform(
        free,
        lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("order"), t["end"].alias("end"), F.lit("term").alias("kind")),
    )
    return F.concat(base_spans(), F.array_distinct(terms).cast(f"array<{SPAN}>"))


def sanitize(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text`` with entities as ``[EMAIL]`` and so on, revealing terms generalised to ``[TERM]`` or removed.

    A term is removed from ``REMOVE_SHARE`` on, generalised from ``GENERALISE_SHARE`` on.  Where entities overlap, the
    first to start stands.  Null text becomes empty.
    """
    found = find_pii(docs, doc_id, text)
    entity = F.concat(*[_replaced(k) for k in KINDS])
    term = F.transform(
        F.col("terms"),
        lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["share"] >= REMOVE_SHARE, F.lit("")).otherwise(F.lit("[TERM]")).alias("with")),
    )
    edits = found.select("doc_id", "text_hash", F.array_sort(F.concat(entity, term)).alias("edits")).distinct()
    base = docs.select(F.col(doc_id).alias("d_id"), F.col(text).alias("d_text"))
    on = base["d_id"].eqNullSafe(edits["doc_id"]) & (F.xxhash64(base["d_text"]) == edits["text_hash"])
    body = whole("d_text")
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def apply(state: Column, e: Column) -> Column:
        step = F.struct(
            e["end"].alias("pos"),
            F.concat(state["out"], F.substring(body, state["pos"] + 1, e["start"] - state["pos"]), e["with"]).alias("out"),
        )
        return F.when(e["start"] >= state["pos"], step).otherwise(state)

    done = F.aggregate("edits", start, apply, lambda s: F.concat(s["out"], F.substring(body, s["pos"] + 1, F.char_length(body))))
    return base.join(edits, on).select(F.col("d_id").alias("doc_id"), done.alias("text"))
