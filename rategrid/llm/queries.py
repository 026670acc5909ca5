"""Registered queries of the operators, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rategrid.llm import (
    alignment,
    conversations,
    decontaminate,
    language,
    lines,
    neardup,
    packing,
    pii,
    rules,
    secrets,
    sharding,
    substrings,
    tokencounts,
)
from rategrid.llm.text import joined

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@register
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in secrets.STRONG],
        F.sha2(joined(F.col("strong")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@register
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), shards=8)


@register
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit_language(docs.filter(~language.held_out()))
    found = language.identify_language(docs, model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@register
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


@register
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(documents(spark, sf_dir), items)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_tokenizer() -> str:
    return tokenizer("word_bpe_49k.json")


@register
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), word_tokenizer())


@register
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(joined(pii.base_spans()), 256).alias("base_sha256"),
        joined(pii.all_spans()).alias("spans"),
    )


@register
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup_substrings(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@register
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir))


@register
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@register
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


@register
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


@register
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations.spliced(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversations.prefix_trie(turns).select(*conversations.DIGEST)


SQL: dict[str, str] = {}

SQL["op5_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
sized AS (SELECT *, least(len(w), 10) AS k FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, k, list_aggregate(w[s:s + k - 1], 'string_agg', ' ') AS span
       FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM sized)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, s, k, list_aggregate(w[s:s + k - 1], 'string_agg', ' ') AS span
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks)),
hit AS (SELECT doc_id, s, k, span FROM dw WHERE span IN (SELECT span FROM iw) AND (k, span) IN (SELECT (k, span) FROM iw)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT hit.doc_id, iw.item FROM hit JOIN iw ON hit.span = iw.span AND hit.k = iw.k) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(cov.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

SQL["op10_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, s.keeper IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

SQL["op8_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, s, list_aggregate(w[s:s + 34], 'string_agg', ' ') AS span
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
rep AS (SELECT span FROM win GROUP BY span HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 35)) AS p FROM win SEMI JOIN rep USING (span))),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT word.doc_id, string_agg(word.word, ' ' ORDER BY word.p) AS text, count(*) AS n
         FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

SQL["op9_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, s, list_aggregate(w[s:s + 4], 'string_agg', ' ') AS span
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS s FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, span FROM win GROUP BY ALL HAVING count(*) > 1),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
          SELECT doc_id, unnest(range(s, s + 5)) AS p FROM win SEMI JOIN rep USING (doc_id, span)) GROUP BY 1),
st AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         len(full_lines) - len(list_distinct(full_lines)) AS n_dup_lines,
         coalesce(hit.n, 0) AS n_repeat_words, len(string_split(text, chr(10))) AS n_lines
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines FROM d) AS d
  LEFT JOIN hit USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM st)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_symbols > n_words OR word_chars > 20 * n_words OR word_chars < 2 * n_words
                                OR 2 * n_dup_lines > n_lines) AS kept
FROM f
"""


def found_sql(name: str, pattern: str, keep: str = "true") -> str:
    """Matches of a pattern in column ``text`` as a list of structs (a, b, v); the pieces between them give positions."""
    before = "list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    return f"""(SELECT doc_id, '{name}' AS kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i:
      struct_pack(a := CAST({before} AS BIGINT), b := CAST({before} + length(m[i]) AS BIGINT), v := m[i])), lambda s: {keep})) AS s
      FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS p FROM body))"""


def _spans_sql(names: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT * FROM {found_sql(k, p, keep)}" for k, (p, keep) in names.items())


_ASSIGN = secrets.ASSIGN.replace("'", "''")
_STRONG_SQL = {
    "assign": (_ASSIGN, f"length(regexp_extract(s.v, '{_ASSIGN}', 2)) >= 6"),
    "access": (secrets.ACCESS, "length(s.v) >= 20"),
    "hex": (secrets.HEX, "true"),
}
_WEAK_SQL = {k: (p.replace("'", "''"), "true") for k, p in secrets.WEAK.items()}
_WEAK_SQL["material"] = (secrets.WEAK["material"], "regexp_matches(s.v, '[0-9]') AND regexp_matches(s.v, '[A-Z]')")
SQL["op1_secrets"] = f"""
WITH body AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
st AS (SELECT doc_id, kind, s.a AS a, s.b AS b FROM ({_spans_sql(_STRONG_SQL)})),
wk AS (SELECT doc_id, kind, s.a AS a, s.b AS b FROM ({_spans_sql(_WEAK_SQL)})),
free AS (SELECT * FROM wk WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.doc_id = wk.doc_id AND st.a < wk.b AND wk.a < st.b)),
parts AS (SELECT *, CASE WHEN kind IN ('identifier', 'access') THEN 'who' WHEN kind = 'endpoint' THEN 'where' ELSE 'what' END AS part
          FROM (SELECT * FROM st UNION ALL SELECT * FROM free)),
linked AS (
  SELECT x.doc_id, x.kind, x.a, x.b FROM parts AS x JOIN parts AS y
    ON x.doc_id = y.doc_id AND y.a <= x.b + {secrets.SCOPE} AND x.a <= y.b + {secrets.SCOPE}
  WHERE x.kind IN ('identifier', 'material', 'endpoint')
  GROUP BY ALL HAVING bool_or(y.part = 'what') AND bool_or(y.part IN ('who', 'where'))),
spans AS (SELECT doc_id, kind, a, b, true AS base FROM st UNION ALL SELECT doc_id, kind, a, b, false FROM linked),
told AS (SELECT *, kind || ':' || a || ':' || b AS told,
         list_position(['assign', 'access', 'hex', 'identifier', 'material', 'endpoint'], kind) AS o FROM spans)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
       count(*) FILTER (kind = 'hex') AS n_hex, sha256(coalesce(string_agg(told, ',' ORDER BY a, o) FILTER (base), '')) AS base_sha256,
       coalesce(string_agg(told, ',' ORDER BY a, o), '') AS spans
FROM documents AS d LEFT JOIN told USING (doc_id) GROUP BY d.doc_id
"""

_PII_SQL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max(list_transform(string_split(s.v, '.'), lambda x: CAST(x AS HUGEINT))) <= 255"),
    "card": (
        r"[0-9](?:[\x20-]?[0-9])+",
        "length(regexp_replace(s.v, '[^0-9]', '', 'g')) BETWEEN 12 AND 19 AND list_sum(list_transform(string_split(reverse(regexp_replace(s.v, "
        "'[^0-9]', '', 'g')), ''), lambda d, i: CASE WHEN i % 2 = 1 THEN CAST(d AS INT) ELSE (2 * CAST(d AS INT)) % 10 + CAST(d AS INT) // 5 END)) % 10 = 0",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(s.v, '[^0-9]', '', 'g')) BETWEEN 9 AND 15"),
}


def _beside_sql(part: str, shift: str, whole_word: str) -> str:
    """Terms beside an entity; ``part`` is the context text, ``shift`` its place."""
    return f"""SELECT doc_id, entity, s.a + base AS a, s.b + base AS b, term FROM (
      SELECT doc_id, entity, base, s, translate(s.v, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, far FROM (
        SELECT doc_id, entity, {shift} AS base, length(full_text) AS far, unnest(list_transform(range(1, len(m) + 1), lambda i:
          struct_pack(a := CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
                      b := CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS BIGINT), v := m[i]))) AS s
        FROM (SELECT *, regexp_extract_all({part}, '\\p{{L}}{{4,}}') AS m, regexp_split_to_array({part}, '\\p{{L}}{{4,}}') AS p FROM ent))
      ) WHERE {whole_word}"""


SQL["op7_pii"] = f"""
WITH body AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({_spans_sql(_PII_SQL)}),
base AS (SELECT doc_id, kind, s.a AS a, s.b AS b, kind || ':' || lower(s.v) AS entity FROM raw),
ent AS (SELECT base.*, greatest(a - 60, 0) AS lo, text AS full_text, substring(text, greatest(a - 60, 0) + 1, a - greatest(a - 60, 0)) AS l,
        substring(text, b + 1, 60) AS r FROM base JOIN body USING (doc_id)),
near AS ({_beside_sql("l", "lo", "s.a > 0 OR base = 0")} UNION ALL {_beside_sql("r", "b", "s.b < 60 OR base + 60 >= far")}),
co AS (SELECT entity, term, count(DISTINCT doc_id) AS co FROM near GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2),
dfe AS (SELECT entity, count(DISTINCT doc_id) AS n FROM near GROUP BY 1),
dft AS (SELECT term, count(*) AS n FROM (
          SELECT DISTINCT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\p{{L}}{{4,}}')) AS term FROM body)
        WHERE term IN (SELECT term FROM co) GROUP BY 1),
share AS (SELECT entity, term, CASE WHEN ln((SELECT count(*) FROM body)::DOUBLE / dfe.n) > 0
            THEN 1.0 - ln(dft.n / co.co::DOUBLE) / ln((SELECT count(*) FROM body)::DOUBLE / dfe.n) ELSE 0 END AS share
          FROM co JOIN dfe USING (entity) JOIN dft USING (term)),
terms AS (SELECT DISTINCT near.doc_id, 'term' AS kind, near.a, near.b FROM near JOIN share USING (entity, term) WHERE share >= {pii.GENERALISE_SHARE}),
free AS (SELECT * FROM terms WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = terms.doc_id AND base.a < terms.b AND terms.a < base.b)),
told AS (SELECT *, kind || ':' || a || ':' || b AS told, list_position(['email', 'ip', 'card', 'phone', 'term'], kind) AS o
         FROM (SELECT doc_id, kind, a, b FROM base UNION ALL SELECT * FROM free))
SELECT d.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
       count(*) FILTER (kind = 'phone') AS n_phone, sha256(coalesce(string_agg(told, ',' ORDER BY a, o) FILTER (kind <> 'term'), '')) AS base_sha256,
       coalesce(string_agg(told, ',' ORDER BY a, o), '') AS spans
FROM documents AS d LEFT JOIN told USING (doc_id) GROUP BY d.doc_id
"""

SQL["op13_prefix_trie"] = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: ascii(d)::BIGINT)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
             lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 1 AS part, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos >= h
  UNION ALL SELECT c.conv_id, 0, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 WHERE pos < h),
d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, role, text FROM r),
p AS (
  SELECT conv_id, depth, sha256(string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS path,
         len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS words FROM d
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM p GROUP BY ALL),
up AS (SELECT n.depth, n.path, p.path AS above FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT above AS path, count(*) AS n FROM up GROUP BY 1),
v AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM n LEFT JOIN kids USING (path)),
total AS (
  SELECT p.path, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.words) AS saved_tokens
  FROM v JOIN p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY 1),
ends AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(path, depth) AS path FROM p GROUP BY 1) GROUP BY 1)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, par.conv_id AS parent_conv_id, v.n_convs, CAST(v.n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM v JOIN total USING (path) LEFT JOIN ends USING (path) LEFT JOIN up USING (path) LEFT JOIN n AS par ON par.path = up.above
"""
