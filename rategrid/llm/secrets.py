"""Secret scans: plain credential patterns and multipart credentials linked within scopes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rategrid.llm.storage import stage
from rategrid.llm.text import SPAN, matches, spans_of, whole

# The strong patterns, by kind in listed order.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # the same matches as shorter runs dropped afterwards
STRONG = ("assign", "access", "hex")

# Weak parts of a multipart credential: each alone proves nothing.
WEAK = {
    "identifier": "(?i)(user|username|login|account|client_?id|access_?key_?id|key_?id)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9_.@-]{3,}",
    "material": "[A-Za-z0-9+/_-]{16,}",
    "endpoint": "(?i)(https?|ftps?|ssh|s3|jdbc|mongodb|postgres|mysql|redis|amqp)://[^\\x20\\x09-\\x0D\"'<>]+",
}
SCOPE = 200  # code points between two parts of one credential


def strong_spans(text: Column) -> dict[str, Column]:
    """Matches by kind, failing ones dropped."""
    assign = F.filter(matches(text, ASSIGN), lambda m: F.char_length(F.regexp_extract(m["value"], ASSIGN, 2)) >= 6)
    access = F.filter(matches(text, ACCESS), lambda m: F.char_length(m["value"]) >= 20)
    return {"assign": assign, "access": access, "hex": matches(text, HEX)}


def weak_spans(text: Column) -> dict[str, Column]:
    """Matches by kind; key material mixes digits and capitals."""
    found = {kind: matches(text, pattern) for kind, pattern in WEAK.items()}
    found["material"] = F.filter(found["material"], lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Z]"))
    return found


def _role(kind: Column) -> Column:
    """Which part of a credential a span can be."""
    return F.when(kind.isin("identifier", "access"), F.lit("who")).when(kind == "endpoint", F.lit("where")).otherwise(F.lit("what"))


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts with complementary parts near: interval join of ``parts`` (key columns, start, end, kind).

    Columns: ``doc_key, start, end, kind``.  Two parts of one document are near if the gap between them is at most
    ``scope``.  A weak part is reported if a secret (``what``) and an identifier or endpoint lie within its reach,
    itself counted.  The join runs on blocks of ``scope`` code points: every part enters the blocks it can reach, so a
    block holds no more parts than fit its width, and a part of any length enters as many blocks as it spans.
    """
    weak = parts.filter(F.col("kind").isin(*WEAK)).select("doc_key", "start", "end", "kind")
    reach = F.explode(
        F.sequence(F.floor((F.greatest(F.col("start") - scope, F.lit(0))) / scope), F.floor((F.col("end") + scope) / scope))
    )
    left = weak.withColumn("block", reach)
    right = parts.select(
        "doc_key",
        F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("block"),
        F.col("start").alias("o_start"),
        F.col("end").alias("o_end"),
        _role(F.col("kind")).alias("o_role"),
    )
    near = (F.col("o_start") <= F.col("end") + scope) & (F.col("start") <= F.col("o_end") + scope)
    met = left.join(right, ["doc_key", "block"]).filter(near)
    seen = met.groupBy("doc_key", "start", "end", "kind").agg(F.collect_set("o_role").alias("roles"))
    own = _role(F.col("kind"))
    roles = F.array_union("roles", F.array(own))
    whole_set = F.array_contains(roles, "what") & (F.array_contains(roles, "who") | F.array_contains(roles, "where"))
    return seen.filter(whole_set).select("doc_key", "start", "end", "kind")


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """All credential spans of every input row: ``doc_id, assign, access, hex`` (matches) and ``spans`` (all of them).

    Strong patterns always count.  Weak parts (identifiers, secret-looking material, endpoints) count only where
    complementary parts lie within ``scope`` code points; material inside a strong span is no part of its own.  Null
    text counts as empty; repeated rows each return; a null id keeps its row.  Documents without a weak part and
    another part do not enter the join.
    """
    body = whole("text")
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = base.select("doc_id", "text", *[c.alias(k) for k, c in strong_spans(body).items()], *[c.alias(k) for k, c in weak_spans(body).items()])
    strong = F.concat(*[spans_of(F.col(k), k, i) for i, k in enumerate(STRONG)])
    strong_kinds = [F.col(k) for k in STRONG]

    def free(m: Column) -> Column:
        clash = [F.exists(c, lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])) for c in strong_kinds]
        return ~reduce(lambda a, b: a | b, clash)

    weak = F.concat(*[spans_of(F.filter(F.col(k), free), k, len(STRONG) + i) for i, k in enumerate(WEAK)])
    columns = ["doc_id", F.xxhash64("text").alias("text_hash"), *STRONG, strong.alias("strong"), weak.alias("weak")]
    spanned = stage(found.select(*columns), "secret-spans")  # the texts are scanned once
    several = spanned.filter((F.size("weak") > 0) & (F.size("weak") + F.size("strong") > 1))
    parts = (
        several.select(F.struct("doc_id", "text_hash").alias("doc_key"), F.explode(F.concat("strong", "weak")).alias("s"))
        .select("doc_key", "s.start", "s.end", "s.kind")
        .distinct()
    )
    linked = link_parts(parts, scope)
    order = F.element_at(F.create_map(*[F.lit(x) for pair in ((k, len(STRONG) + i) for i, k in enumerate(WEAK)) for x in pair]), F.col("kind"))
    extra = (
        linked.groupBy("doc_key")
        .agg(F.collect_set(F.struct("start", order.alias("order"), "end", "kind")).alias("extra"))
        .select(F.col("doc_key.doc_id").alias("e_id"), F.col("doc_key.text_hash").alias("e_hash"), "extra")
    )
    on = spanned["doc_id"].eqNullSafe(extra["e_id"]) & (spanned["text_hash"] == extra["e_hash"])
    none = F.array().cast(f"array<{SPAN}>")
    full = spanned.select("doc_id", "text_hash", *STRONG, "strong").join(extra, on, "left")
    return full.select("doc_id", *STRONG, "strong", F.concat("strong", F.coalesce("extra", none)).alias("spans"))
