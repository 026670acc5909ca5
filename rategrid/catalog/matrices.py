"""Binary-matrix queries: sparse statistics, ranks, entropies and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rategrid.catalog import views as V
from rategrid.catalog.base import Tables, query
from rategrid.functions.tables import register_tables
from rategrid.operators import distances as dist
from rategrid.operators import gf2, incidence as inc

KEY = ["sample_seed"]

FULL_SQL = (
    V.MATRIX_SQL
    + """,
qs AS (SELECT sample_seed, n_cols, CAST(unnest(range(0, n_cols)) AS INTEGER) AS q FROM dims),
rs AS (SELECT sample_seed, n_cols, CAST(unnest(range(0, n_rows)) AS INTEGER) AS r FROM dims),
cols AS (SELECT sample_seed, q, count(e.r) AS weight, coalesce(sum(e.x), 0) AS x_weight FROM qs LEFT JOIN entries e USING (sample_seed, q) GROUP BY 1, 2),
rws AS (SELECT sample_seed, r, any_value(n_cols) AS n_cols, count(e.q) AS weight, coalesce(sum(e.x), 0) AS x_weight
        FROM rs LEFT JOIN entries e USING (sample_seed, r) GROUP BY 1, 2)"""
)


def _moment_sql(source: str, mean: str, tag: str) -> str:
    skew = (
        f"(SELECT avg(pow((c.weight - m.mu) / m.sd, 3)) FROM {source} c WHERE c.sample_seed = m.sample_seed)"
    )
    return f"""m_{tag} AS (SELECT sample_seed, avg(weight) AS mu, var_pop(weight) AS va, stddev_pop(weight) AS sd,
  CAST(max(weight) AS DOUBLE) AS mx, CAST(min(weight) AS DOUBLE) AS mn FROM {source} GROUP BY 1),
s_{tag} AS (SELECT sample_seed, mu AS {mean}, va AS var_{tag}, sd AS std_{tag}, CASE WHEN mu > 0 THEN sd / mu ELSE 0 END AS cv_{tag},
  mx AS {tag}_max, mn AS {tag}_min, CASE WHEN sd > 1e-15 THEN {skew} ELSE 0 END AS skew_{tag} FROM m_{tag} m)"""


PEI_SQL = """pc AS (SELECT e.sample_seed, e.q, min(w.weight) AS lo, max(w.weight) AS hi FROM entries e JOIN rws w USING (sample_seed, r)
      WHERE e.x = 1 GROUP BY 1, 2),
pei AS (SELECT d.sample_seed, coalesce(sum(lo), 0) / any_value(n_cols) AS pei_proxy, coalesce(sum(hi), 0) / any_value(n_cols) AS wcp_proxy,
      CASE WHEN coalesce(sum(lo), 0) > 0 THEN sum(hi) / sum(lo) ELSE 1.0 END AS pivot_speedup, count(pc.q) AS n_anticommuting_qubits
      FROM dims d LEFT JOIN pc USING (sample_seed) GROUP BY 1)"""

WEIGHT_DOUBLES = (
    "abar var_a std_a cv_a a_max a_min skew_a wbar var_w std_w cv_w w_max w_min skew_w wbar_stab wbar_destab mean_wt_x"
    " weight_mass pei_proxy wcp_proxy pivot_speedup"
).split()


@query(
    "weight_stats",
    f"""WITH {FULL_SQL}, {_moment_sql("cols", "abar", "a")}, {_moment_sql("rws", "wbar", "w")}, {PEI_SQL},
    split AS (SELECT sample_seed, sum(CASE WHEN r >= n_cols THEN weight ELSE 0 END) / any_value(n_cols) AS wbar_stab,
       sum(CASE WHEN r < n_cols THEN weight ELSE 0 END) / any_value(n_cols) AS wbar_destab, avg(x_weight) AS mean_wt_x,
       CAST(sum(weight) AS DOUBLE) AS weight_mass FROM rws GROUP BY 1)
    SELECT *, weight_mass = (SELECT sum(weight) FROM cols c WHERE c.sample_seed = s_a.sample_seed) AS identity_holds
    FROM s_a JOIN s_w USING (sample_seed) JOIN split USING (sample_seed) JOIN pei USING (sample_seed)""",
    WEIGHT_DOUBLES,
)
def weight_stats(t: Tables) -> DataFrame:
    return inc.weight_stats(V.matrix_entries(t), V.matrix_dims(t), KEY)


@query("pivot_effectiveness", f"WITH {FULL_SQL}, {PEI_SQL} SELECT * FROM pei", ("pei_proxy", "wcp_proxy", "pivot_speedup"))
def pivot_effectiveness(t: Tables) -> DataFrame:
    return inc.pivot_effectiveness(V.matrix_entries(t), V.matrix_dims(t), KEY)


@query("active_count", f"WITH {FULL_SQL} SELECT sample_seed, avg(weight) AS abar FROM cols GROUP BY 1", ("abar",))
def active_count(t: Tables) -> DataFrame:
    return inc.active_count(V.matrix_entries(t), V.matrix_dims(t), KEY)


def _pmf_sql(source: str, value: str) -> str:
    return f"""WITH {FULL_SQL}, bins AS (SELECT sample_seed, CAST({value} AS BIGINT) AS bin, count(*) AS c FROM {source} GROUP BY 1, 2)
        SELECT sample_seed, bin, c / (SELECT count(*) FROM {source} s WHERE s.sample_seed = bins.sample_seed) AS share FROM bins"""


@query("column_weight_pmf", _pmf_sql("cols", "weight"), ("share",))
def column_weight_pmf(t: Tables) -> DataFrame:
    return inc.weight_pmf(V.matrix_entries(t), V.matrix_dims(t), KEY, "q")


@query("row_weight_pmf", _pmf_sql("rws", "weight"), ("share",))
def row_weight_pmf(t: Tables) -> DataFrame:
    return inc.weight_pmf(V.matrix_entries(t), V.matrix_dims(t), KEY, "r")


@query("x_weight_pmf", _pmf_sql("rws", "x_weight"), ("share",))
def x_weight_pmf(t: Tables) -> DataFrame:
    return inc.weight_pmf(V.matrix_entries(t), V.matrix_dims(t), KEY, "r", "x_weight")


@query(
    "weight_mass_audit",
    f"""WITH {FULL_SQL}, a AS (SELECT sample_seed, sum(weight) AS total_columns, sum(x_weight) AS total_x_columns FROM cols WHERE weight > 0 GROUP BY 1),
        b AS (SELECT sample_seed, sum(weight) AS total_rows, sum(x_weight) AS total_x_rows FROM rws WHERE r <> 5 AND weight > 0 GROUP BY 1)
        SELECT sample_seed, CAST(coalesce(total_columns, 0) AS BIGINT) AS total_columns, CAST(coalesce(total_rows, 0) AS BIGINT) AS total_rows,
        CAST(coalesce(total_x_columns, 0) AS BIGINT) AS total_x_columns, CAST(coalesce(total_x_rows, 0) AS BIGINT) AS total_x_rows,
        coalesce(total_columns, 0) = coalesce(total_rows, 0) AS total_pass, coalesce(total_x_columns, 0) = coalesce(total_x_rows, 0) AS x_pass
        FROM a FULL JOIN b USING (sample_seed)""",
)
def weight_mass_audit(t: Tables) -> DataFrame:
    """Audit against a row table that misses one row index on purpose."""
    entries = V.matrix_entries(t)
    return inc.audit_identity(inc.marginal(entries, KEY, "q"), inc.marginal(entries, KEY, "r").where("r <> 5"), KEY)


@query(
    "weight_spectrum",
    f"WITH {FULL_SQL} SELECT sample_seed, list(CAST(weight AS INTEGER) ORDER BY r) AS weights FROM rws GROUP BY 1",
)
def weight_spectrum(t: Tables) -> DataFrame:
    return inc.weight_spectrum(V.matrix_entries(t), V.matrix_dims(t), KEY)


LABEL_SQL = "CASE WHEN x = 1 AND z = 1 THEN 'Y' WHEN x = 1 THEN 'X' ELSE 'Z' END"
ROLE_SQL = "CASE WHEN r >= n_cols THEN 'stabilizer' ELSE 'destabilizer' END"


@query(
    "bipartite_edges",
    f"WITH {V.MATRIX_SQL} SELECT sample_seed, q, r, {LABEL_SQL} AS label, {ROLE_SQL} AS role FROM entries JOIN dims USING (sample_seed)",
)
def bipartite_edges(t: Tables) -> DataFrame:
    return inc.bipartite_edges(V.matrix_entries(t), V.matrix_dims(t), KEY)


@query(
    "bipartite_nodes",
    f"""WITH {FULL_SQL} SELECT sample_seed, q AS node, 'column' AS role, weight AS degree FROM cols
        UNION ALL SELECT sample_seed, r, {ROLE_SQL}, weight FROM rws""",
)
def bipartite_nodes(t: Tables) -> DataFrame:
    return inc.bipartite_nodes(V.matrix_entries(t), V.matrix_dims(t), KEY)


@query(
    "bipartite_nodes_stabilizers",
    f"""WITH {FULL_SQL} SELECT sample_seed, q AS node, 'column' AS role,
        (SELECT count(*) FROM entries e WHERE e.sample_seed = c.sample_seed AND e.q = c.q AND e.r >= {V.N_COLS}) AS degree FROM cols c
        UNION ALL SELECT sample_seed, r, 'stabilizer', weight FROM rws WHERE r >= n_cols""",
)
def bipartite_nodes_stabilizers(t: Tables) -> DataFrame:
    return inc.bipartite_nodes(V.matrix_entries(t), V.matrix_dims(t), KEY, all_rows=False)


@query(
    "hyperedges",
    f"""WITH {FULL_SQL} SELECT w.sample_seed, w.r, coalesce(list(e.q ORDER BY e.q) FILTER (e.q IS NOT NULL), []) AS columns,
        coalesce(string_agg(e.q || ':' || {LABEL_SQL}, ',' ORDER BY e.q) FILTER (e.q IS NOT NULL), '') AS labels,
        any_value(CASE WHEN w.r >= n_cols THEN 'stabilizer' ELSE 'destabilizer' END) AS role, CAST(count(e.q) AS INTEGER) AS weight
        FROM rws w LEFT JOIN entries e ON e.sample_seed = w.sample_seed AND e.r = w.r GROUP BY 1, 2""",
)
def hyperedges(t: Tables) -> DataFrame:
    edges = inc.hyperedges(V.matrix_entries(t), V.matrix_dims(t), KEY)
    # maps have no order: show them as text for comparison
    shown = F.transform("columns", lambda q: F.concat(q.cast("string"), F.lit(":"), F.col("labels")[q]))
    return edges.withColumn("labels", F.array_join(shown, ","))


@query(
    "bandwidth",
    f"""WITH {V.MATRIX_SQL}, g AS (SELECT sample_seed, r, q - lag(q) OVER (PARTITION BY sample_seed, r ORDER BY q) AS gap, q FROM entries),
        b AS (SELECT sample_seed, r, {V.N_COLS} - greatest(max(gap), (min(q) + {V.N_COLS} - max(q)) % {V.N_COLS}) AS bw FROM g GROUP BY 1, 2 HAVING count(*) > 1)
        SELECT sample_seed, CAST(coalesce(max(bw), 0) AS INTEGER) AS bandwidth FROM dims LEFT JOIN b USING (sample_seed) GROUP BY 1""",
)
def bandwidth(t: Tables) -> DataFrame:
    return inc.bandwidth(V.matrix_entries(t), V.matrix_dims(t), KEY)


# ---------------------------------------------------------------- packed words


def _packed(t: Tables) -> DataFrame:
    return inc.pack_rows(V.matrix_entries(t), KEY, V.N_COLS)


PACK_SQL = (
    V.MATRIX_SQL
    + """, packed AS (SELECT sample_seed, r, CAST(sum(CASE WHEN x = 1 THEN CAST(1 AS BIGINT) << q ELSE 0 END) AS BIGINT) AS xw,
  CAST(sum(CASE WHEN z = 1 THEN CAST(1 AS BIGINT) << q ELSE 0 END) AS BIGINT) AS zw FROM entries GROUP BY 1, 2)"""
)


@query("packed_rows", f"WITH {PACK_SQL} SELECT sample_seed, r, [xw, zw] AS words FROM packed")
def packed_rows(t: Tables) -> DataFrame:
    return _packed(t)


@query("unpacked_rows", f"WITH {V.MATRIX_SQL} SELECT sample_seed, r, q, x, z FROM entries")
def unpacked_rows(t: Tables) -> DataFrame:
    return inc.unpack_rows(_packed(t), KEY, V.N_COLS)


@query("packed_popcount", f"WITH {PACK_SQL} SELECT sample_seed, sum(bit_count(xw | zw)) / {V.N_COLS} AS abar FROM packed GROUP BY 1", ("abar",))
def packed_popcount(t: Tables) -> DataFrame:
    weight = F.sum(inc.packed_weight(F.col("words"))) / F.lit(V.N_COLS)
    return _packed(t).groupBy("sample_seed").agg(weight.alias("abar"))


@query("xor_of_rows", f"WITH {PACK_SQL} SELECT sample_seed, r % 4 AS g, [bit_xor(xw), bit_xor(zw)] AS words FROM packed GROUP BY 1, 2")
def xor_of_rows(t: Tables) -> DataFrame:
    grouped = _packed(t).withColumn("g", F.col("r") % 4)
    return inc.xor_rows(grouped, ["sample_seed", "g"], V.N_COLS)


@query(
    "xor_of_columns",
    f"""WITH {V.MATRIX_SQL} SELECT sample_seed, r, q % 8 AS q, CAST(sum(x) % 2 AS INTEGER) AS x, CAST(sum(z) % 2 AS INTEGER) AS z
        FROM entries GROUP BY 1, 2, 3 HAVING sum(x) % 2 = 1 OR sum(z) % 2 = 1""",
)
def xor_of_columns(t: Tables) -> DataFrame:
    entries = V.matrix_entries(t)
    groups = entries.select("q").distinct().withColumn("g", F.col("q") % 8)
    return inc.xor_columns(entries, KEY, groups)


@query(
    "restricted_columns",
    f"""WITH {V.MATRIX_SQL}, subset AS (SELECT q % 3 AS subset_id, q, row_number() OVER (PARTITION BY q % 3 ORDER BY q) - 1 AS pos,
          count(*) OVER (PARTITION BY q % 3) AS size FROM (SELECT DISTINCT q FROM entries))
        SELECT sample_seed, subset_id, r, CAST(pos AS INTEGER) AS c FROM entries JOIN subset USING (q) WHERE x = 1
        UNION ALL SELECT sample_seed, subset_id, r, CAST(pos + size AS INTEGER) FROM entries JOIN subset USING (q) WHERE z = 1""",
)
def restricted_columns(t: Tables) -> DataFrame:
    entries = V.matrix_entries(t)
    lists = entries.groupBy((F.col("q") % 3).alias("subset_id")).agg(F.array_sort(F.collect_set("q")).alias("m"))
    subset = lists.select("subset_id", F.posexplode("m").alias("pos", "q"), F.size("m").alias("size"))
    return inc.restrict_columns(entries, KEY, subset)


def _single_vectors(t: Tables) -> DataFrame:
    """X, Y and Z on each single column that occurs: v = 3 q + type."""
    types = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("vx"), F.lit(z).alias("vz")) for i, x, z in ((0, 1, 0), (1, 1, 1), (2, 0, 1))]))
    columns = V.matrix_entries(t).select("q").distinct().select("q", types.alias("t"))
    return columns.select(
        F.lit(V.N_COLS).alias("n_cols"), (3 * F.col("q") + F.col("t.i")).alias("v"), "q", "t.vx", "t.vz"
    )


VECTORS_SQL = """vecs AS (SELECT 3 * q + i AS v, q, vx, vz FROM (SELECT DISTINCT q FROM entries),
  (VALUES (0, 1, 0), (1, 1, 1), (2, 0, 1)) AS types(i, vx, vz))"""


@query(
    "commutation",
    f"""WITH {V.MATRIX_SQL}, {VECTORS_SQL}, odd AS (SELECT sample_seed, v, count(*) AS c FROM entries JOIN vecs USING (q)
          WHERE (x * vz + z * vx) % 2 = 1 GROUP BY 1, 2)
        SELECT sample_seed, v, coalesce(c, 0) AS clashes, c IS NULL AS commutes FROM (SELECT sample_seed, v FROM dims, vecs) LEFT JOIN odd USING (sample_seed, v)""",
)
def commutation(t: Tables) -> DataFrame:
    return inc.commutation(V.matrix_entries(t), V.matrix_dims(t), _single_vectors(t), KEY)


@query(
    "commutation_lists",
    f"""WITH {V.MATRIX_SQL}, {VECTORS_SQL}, odd AS (SELECT sample_seed, v, count(*) AS c FROM entries JOIN vecs USING (q)
          WHERE (x * vz + z * vx) % 2 = 1 GROUP BY 1, 2)
        SELECT sample_seed, (SELECT count(*) FROM vecs) AS n_listed, coalesce(string_agg(v || ':' || c, ',' ORDER BY v), '') AS clashing
        FROM dims LEFT JOIN odd USING (sample_seed) GROUP BY 1""",
)
def commutation_lists(t: Tables) -> DataFrame:
    """One row per matrix, only the vectors that do not commute are named."""
    found = inc.commutation_lists(V.matrix_entries(t), V.matrix_dims(t), _single_vectors(t), KEY)
    told = F.array_join(F.transform("clashing", lambda c: F.concat_ws(":", c["v"], c["clashes"])), ",")
    return found.select("sample_seed", "n_listed", told.alias("clashing"))


# ---------------------------------------------------------------- ranks and reduced forms


def _rank_sql(rows: str, key: str = "sample_seed") -> str:
    """Rank by removing one pivot row per bit: rows that vanish from step to step."""
    return f"""elim(key, r, w, c) AS (SELECT {key}, r, w, 0 FROM {rows}
  UNION ALL SELECT key, r, CASE WHEN (w >> CAST(c AS HUGEINT)) & 1 = 1 THEN xor(w, pw) ELSE w END, c + 1 FROM (
    SELECT *, min(r) FILTER ((w >> CAST(c AS HUGEINT)) & 1 = 1) OVER (PARTITION BY key) AS pr,
           arg_min(w, r) FILTER ((w >> CAST(c AS HUGEINT)) & 1 = 1) OVER (PARTITION BY key) AS pw FROM elim WHERE c < 64)
  WHERE r IS DISTINCT FROM pr),
ranks AS (SELECT key, count(*) FILTER (c = 0) - count(*) FILTER (c = 64) AS rank FROM elim GROUP BY key)"""


RREF_SQL = """full_elim(key, r, w, piv, c) AS (SELECT sample_seed, r, w, CAST(NULL AS INTEGER), 0 FROM vectors
  UNION ALL SELECT key, r, CASE WHEN (w >> CAST(c AS HUGEINT)) & 1 = 1 AND r IS DISTINCT FROM pr AND pr IS NOT NULL THEN xor(w, pw) ELSE w END,
     CASE WHEN r = pr THEN c ELSE piv END, c + 1 FROM (
    SELECT *, min(r) FILTER ((w >> CAST(c AS HUGEINT)) & 1 = 1 AND piv IS NULL) OVER (PARTITION BY key) AS pr,
           arg_min(w, r) FILTER ((w >> CAST(c AS HUGEINT)) & 1 = 1 AND piv IS NULL) OVER (PARTITION BY key) AS pw FROM full_elim WHERE c < 64)),
rref AS (SELECT key AS sample_seed, w, piv FROM full_elim WHERE c = 64 AND piv IS NOT NULL)"""

MATRIX_ROWS_SQL = PACK_SQL + ", vectors AS (SELECT sample_seed, r, CAST(xw AS HUGEINT) + (CAST(zw AS HUGEINT) << 32) AS w FROM packed)"


def _sign_spaces(t: Tables) -> DataFrame:
    return gf2.row_spaces(V.sign_rows(t), V.sign_dims(t), KEY)


def _matrix_spaces(t: Tables) -> DataFrame:
    return gf2.row_spaces(_packed(t), V.matrix_dims(t), KEY)


@query("gf2_rank_signs", f"WITH RECURSIVE {V.SIGNS_SQL}, {_rank_sql('vectors')} SELECT key AS sample_seed, CAST(rank AS INTEGER) AS rank, CAST(rank - 32 AS INTEGER) AS k FROM ranks")
def gf2_rank_signs(t: Tables) -> DataFrame:
    return _sign_spaces(t).select("sample_seed", gf2.rank().alias("rank"), gf2.code_dimension().alias("k"))


@query(
    "gf2_rank_matrices",
    f"""WITH RECURSIVE {MATRIX_ROWS_SQL}, {_rank_sql('vectors')} SELECT sample_seed, CAST(coalesce(rank, 0) AS INTEGER) AS rank,
        CAST(coalesce(rank, 0) - n_cols AS INTEGER) AS k FROM dims LEFT JOIN ranks ON key = sample_seed""",
)
def gf2_rank_matrices(t: Tables) -> DataFrame:
    return _matrix_spaces(t).select("sample_seed", gf2.rank().alias("rank"), gf2.code_dimension().alias("k"))


@query(
    "reduced_rows_udtf",
    f"""WITH RECURSIVE {V.SIGNS_SQL}, {RREF_SQL} SELECT sample_seed, CAST(row_number() OVER (PARTITION BY sample_seed ORDER BY piv) - 1 AS INTEGER) AS i,
        [CAST(w & 4294967295 AS BIGINT), CAST(w >> 32 AS BIGINT)] AS words FROM rref""",
)
def reduced_rows_udtf(t: Tables) -> DataFrame:
    """The table function in SQL: parts of each matrix first, then what is left of them."""
    register_tables(t.spark)
    return t.spark.sql(
        """
        WITH parts AS (SELECT * FROM reduced_rows(TABLE(
          SELECT *, pmod(xxhash64(words), 8) AS salt FROM (SELECT DISTINCT * FROM {rows}) AS once) PARTITION BY (sample_seed, salt)))
        SELECT * FROM reduced_rows(TABLE(SELECT sample_seed, words FROM parts) PARTITION BY sample_seed)""",
        rows=V.sign_rows(t),
    )


@query(
    "gf2_reduced_rows",
    f"""WITH RECURSIVE {V.SIGNS_SQL}, {RREF_SQL} SELECT sample_seed, CAST(row_number() OVER (PARTITION BY sample_seed ORDER BY piv) - 1 AS INTEGER) AS i,
        [CAST(w & 4294967295 AS BIGINT), CAST(w >> 32 AS BIGINT)] AS words FROM rref""",
)
def gf2_reduced_rows(t: Tables) -> DataFrame:
    return gf2.reduced_rows(_sign_spaces(t), KEY)


@query(
    "gf2_same_row_space",
    f"""WITH RECURSIVE {MATRIX_ROWS_SQL}, {_rank_sql('vectors')},
        thin AS (SELECT sample_seed AS s2, r AS r2, w AS w2 FROM vectors WHERE r <> 7),
        {_rank_sql('thin', 's2').replace('elim', 'elim2').replace('ranks', 'ranks2').replace('SELECT s2, r, w, 0', 'SELECT s2, r2, w2, 0')}
        SELECT sample_seed, CAST(coalesce(a.rank, 0) AS INTEGER) AS rank_a, CAST(coalesce(b.rank, 0) AS INTEGER) AS rank_b,
               coalesce(a.rank, 0) = coalesce(b.rank, 0) AS equal FROM dims LEFT JOIN ranks a ON a.key = sample_seed LEFT JOIN ranks2 b ON b.key = sample_seed""",
)
def gf2_same_row_space(t: Tables) -> DataFrame:
    """Does each matrix keep its row space when row 7 is dropped?"""
    thinner = gf2.row_spaces(_packed(t).where("r <> 7"), V.matrix_dims(t), KEY)
    return gf2.same_row_space(_matrix_spaces(t), thinner, KEY)


# ---------------------------------------------------------------- subset entropies


def _masked_sql(masks: str) -> str:
    """Rank of the rows under each mask: ``masks(id, mask, size)``; key = seed * 100000 + id."""
    return f"""masks AS ({masks}), masked AS (SELECT sample_seed * 100000 + id AS mk, r, w & mask AS w FROM vectors, masks),
  {_rank_sql('masked', 'mk')},
  entropy AS (SELECT CAST(key // 100000 AS INTEGER) AS sample_seed, CAST(key % 100000 AS INTEGER) AS id, CAST(rank - size AS INTEGER) AS s
              FROM ranks JOIN masks ON id = key % 100000)"""


def _bits(low: str, high: str) -> str:
    return f"((CAST(1 AS HUGEINT) << CAST({high} AS HUGEINT)) - (CAST(1 AS HUGEINT) << CAST({low} AS HUGEINT)))"


def _both(mask: str) -> str:
    return f"({mask} + ({mask} << CAST(32 AS HUGEINT)))"


PROFILE_MASKS = f"SELECT CAST(ell AS INTEGER) AS id, ell AS size, {_both(_bits('0', 'ell'))} AS mask FROM (SELECT unnest(range(1, 17)) AS ell)"


@query(
    "entropy_profile",
    f"WITH RECURSIVE {V.SIGNS_SQL}, {_masked_sql(PROFILE_MASKS)} SELECT sample_seed, id AS ell, s FROM entropy",
)
def entropy_profile(t: Tables) -> DataFrame:
    return gf2.entropy_profile(_sign_spaces(t), KEY)


@query("half_cut_entropy", f"WITH RECURSIVE {V.SIGNS_SQL}, {_masked_sql(PROFILE_MASKS)} SELECT sample_seed, CAST(s AS DOUBLE) AS entropy_half_cut FROM entropy WHERE id = 16")
def half_cut_entropy(t: Tables) -> DataFrame:
    return gf2.half_cut_entropy(_sign_spaces(t), KEY)


A, B, C = _bits("0", "10"), _bits("10", "21"), _bits("21", "32")
TMI_MASKS = " UNION ALL ".join(
    f"SELECT {i} AS id, {size} AS size, {_both(mask)} AS mask"
    for i, (size, mask) in enumerate(
        [(10, A), (11, B), (11, C), (21, f"({A} + {B})"), (21, f"({A} + {C})"), (22, f"({B} + {C})"), (32, f"({A} + {B} + {C})")]
    )
)


@query(
    "tripartite_information",
    f"""WITH RECURSIVE {V.SIGNS_SQL}, {_masked_sql(TMI_MASKS)} SELECT sample_seed,
        CAST(sum(CASE WHEN id IN (3, 4, 5) THEN -s ELSE s END) AS DOUBLE) AS tmi FROM entropy GROUP BY 1""",
)
def tripartite_information(t: Tables) -> DataFrame:
    return gf2.tripartite_information(_sign_spaces(t), KEY)


ALL_ARCS = f"""SELECT CAST(start * 100 + ell AS INTEGER) AS id, ell AS size,
    {_both("list_sum(list_transform(range(0, ell), lambda j: CAST(1 AS HUGEINT) << CAST((start + j) % 32 AS HUGEINT)))")} AS mask
  FROM (SELECT unnest(range(0, 32)) AS start), (SELECT unnest(range(1, 17)) AS ell)"""


@query(
    "arc_subsets_udtf",
    f"""WITH RECURSIVE {V.SIGNS_SQL}, {_masked_sql(ALL_ARCS)}
        SELECT sample_seed, CAST(id // 100 AS INTEGER) AS start, CAST(id % 100 AS INTEGER) AS ell, s FROM entropy""",
)
def arc_subsets_udtf(t: Tables) -> DataFrame:
    """Arcs from the table function in SQL, then their entropies in every matrix of that size."""
    register_tables(t.spark)
    arcs = t.spark.sql(
        """SELECT n_cols, 1000 * start + ell AS subset_id, members
           FROM (SELECT DISTINCT n_cols FROM {dims}) AS sizes, LATERAL arc_subsets(n_cols)
           WHERE ell <= n_cols div 2""",
        dims=V.sign_dims(t),
    )
    found = gf2.subset_entropy(_sign_spaces(t), arcs, KEY)
    start = F.floor(F.col("subset_id") / 1000).cast("int")
    return found.select(*KEY, start.alias("start"), (F.col("subset_id") % 1000).alias("ell"), F.col("entropy").alias("s"))


@query(
    "entropy_profile_all_starts",
    f"""WITH RECURSIVE {V.SIGNS_SQL}, {_masked_sql(ALL_ARCS)}
        SELECT sample_seed, CAST(id // 100 AS INTEGER) AS start, CAST(id % 100 AS INTEGER) AS ell, s FROM entropy""",
)
def entropy_profile_all_starts(t: Tables) -> DataFrame:
    return gf2.entropy_profiles(_sign_spaces(t), KEY)


STRIDE_MASKS = f"""SELECT m * 32 + o AS id, len(qs) AS size, {_both("list_sum(list_transform(qs, lambda q: CAST(1 AS HUGEINT) << CAST(q AS HUGEINT)))")} AS mask
  FROM (SELECT CAST(m AS INTEGER) AS m, CAST(o AS INTEGER) AS o, range(o, 32, m) AS qs FROM (SELECT unnest([2, 3, 5, 8]) AS m), (SELECT unnest(range(0, 8)) AS o) WHERE o < m)"""


@query(
    "subset_entropy",
    f"WITH RECURSIVE {V.SIGNS_SQL}, {_masked_sql(STRIDE_MASKS)} SELECT sample_seed, id AS subset_id, s AS entropy FROM entropy",
)
def subset_entropy(t: Tables) -> DataFrame:
    """Entropy of strided column sets of every label's matrix."""
    return gf2.subset_entropy(_sign_spaces(t), _strided(t), KEY)


@query(
    "subset_entropy_lists",
    f"""WITH RECURSIVE {V.SIGNS_SQL}, {_masked_sql(STRIDE_MASKS)} SELECT sample_seed, string_agg(id, ',' ORDER BY id) AS subset_ids,
          string_agg(CAST(s AS INTEGER), ',' ORDER BY id) AS entropies FROM entropy GROUP BY 1""",
)
def subset_entropy_lists(t: Tables) -> DataFrame:
    """The same entropies as one row per matrix."""
    found = gf2.entropy_lists(_sign_spaces(t), _strided(t), KEY)
    return found.select("sample_seed", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("subset_ids", "entropies")])


def _strided(t: Tables) -> DataFrame:
    """Every m-th column from o on, with m * 32 + o as the set's id."""
    strides = V.sign_dims(t).select("n_cols").distinct().select("n_cols", F.explode(F.array(*[F.lit(m) for m in (2, 3, 5, 8)])).alias("m"))
    offsets = strides.select("n_cols", "m", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("o"))
    ident = (F.col("m") * 32 + F.col("o")).alias("subset_id")
    return offsets.select("n_cols", ident, F.sequence("o", F.col("n_cols") - 1, "m").alias("members"))


# ---------------------------------------------------------------- distances

# id + 1000 marks the complement of a set
SPLIT_MASKS = f"""SELECT id, size, mask FROM ({STRIDE_MASKS}) UNION ALL SELECT id + 1000, 32 - size, {_both(_bits("0", "32"))} - mask FROM ({STRIDE_MASKS})"""


@query(
    "subset_information",
    f"""WITH RECURSIVE {V.SIGNS_SQL}, {_rank_sql('vectors').replace('elim', 'elim0').replace('ranks', 'ranks0')}, {_masked_sql(SPLIT_MASKS)}
        SELECT a.sample_seed, a.id AS subset_id, a.s + r.rank - 32 - b.s > 0 AS informative FROM entropy a
        JOIN entropy b ON b.sample_seed = a.sample_seed AND b.id = a.id + 1000 JOIN ranks0 r ON r.key = a.sample_seed WHERE a.id < 1000""",
)
def subset_information(t: Tables) -> DataFrame:
    return dist.subset_information(_sign_spaces(t), _strided(t), KEY)


@query(
    "subset_information_lists",
    f"""WITH RECURSIVE {V.SIGNS_SQL}, {_rank_sql('vectors').replace('elim', 'elim0').replace('ranks', 'ranks0')}, {_masked_sql(SPLIT_MASKS)}
        SELECT a.sample_seed, count(*) AS n_listed, coalesce(string_agg(a.id, ',' ORDER BY a.id) FILTER (a.s + r.rank - 32 - b.s > 0), '') AS informative
        FROM entropy a JOIN entropy b ON b.sample_seed = a.sample_seed AND b.id = a.id + 1000 JOIN ranks0 r ON r.key = a.sample_seed
        WHERE a.id < 1000 GROUP BY 1""",
)
def subset_information_lists(t: Tables) -> DataFrame:
    """One row per matrix, only the informative sets are named."""
    found = dist.information_lists(_sign_spaces(t), _strided(t), KEY)
    return found.select("sample_seed", "n_listed", F.array_join(F.col("informative").cast("array<string>"), ",").alias("informative"))


ARC_MASKS = f"""SELECT start * 100 + len AS id, len AS size, {_both("list_sum(list_transform(range(0, len), lambda j: CAST(1 AS HUGEINT) << CAST((start + j) % 32 AS HUGEINT)))")} AS mask
  FROM (SELECT unnest([0, 8, 16, 24]) AS start), (SELECT unnest(range(1, 32)) AS len)"""
DCONT_SQL = f"""
  {_masked_sql(ARC_MASKS)}, total AS (SELECT key AS sample_seed, rank - 32 AS k FROM ranks0),
  info AS (SELECT e.sample_seed, e.id // 100 AS start, e.id % 100 AS len FROM entropy e JOIN total USING (sample_seed)
    JOIN entropy o ON o.sample_seed = e.sample_seed AND o.id = ((e.id // 100 + e.id % 100) % 32) * 100 + 32 - e.id % 100 WHERE e.s + k - o.s > 0)"""


def _arc_pairs_sql() -> str:
    """Arcs and their complements (the complement starts where the arc ends)."""
    masks = ARC_MASKS.replace("unnest([0, 8, 16, 24]) AS start", "unnest(range(0, 32)) AS start")
    return DCONT_SQL.replace(ARC_MASKS, masks)


@query(
    "contiguous_distance",
    f"""WITH RECURSIVE {V.SIGNS_SQL}, {_rank_sql('vectors').replace('elim', 'elim0').replace('ranks', 'ranks0')}, {_arc_pairs_sql()},
        best AS (SELECT sample_seed, min(len) AS d FROM info WHERE start IN (0, 8, 16, 24) GROUP BY 1)
        SELECT sample_seed, CAST(k AS INTEGER) AS k, CAST(CASE WHEN k = 0 THEN 0 ELSE coalesce(d, 32) END AS INTEGER) AS d_cont
        FROM total LEFT JOIN best USING (sample_seed)""",
)
def contiguous_distance(t: Tables) -> DataFrame:
    return dist.contiguous_distance(_sign_spaces(t), KEY).select("sample_seed", "k", "d_cont")


@query(
    "contiguous_distance_all_starts",
    f"""WITH RECURSIVE {V.SIGNS_SQL}, {_rank_sql('vectors').replace('elim', 'elim0').replace('ranks', 'ranks0')}, {_arc_pairs_sql()},
        best AS (SELECT sample_seed, min(struct_pack(len := len, start := start)) AS b FROM info GROUP BY 1)
        SELECT sample_seed, CAST(k AS INTEGER) AS k, CAST(CASE WHEN k = 0 THEN 0 ELSE coalesce(b.len, 32) END AS INTEGER) AS d_cont,
               CAST(CASE WHEN k <> 0 THEN coalesce(b.start, 0) END AS INTEGER) AS start FROM total LEFT JOIN best USING (sample_seed)""",
)
def contiguous_distance_all_starts(t: Tables) -> DataFrame:
    return dist.shortest_arc(_sign_spaces(t), KEY)


# A set carries information exactly if more vectors on it lie in the row space than are
# orthogonal to it (plain dot product).
SMALL_SETS_SQL = """places AS (SELECT CAST(unnest(range(0, 32)) AS INTEGER) AS q),
small_sets AS (SELECT 1 AS size, a.q AS qa, a.q AS qb FROM places a UNION ALL SELECT 2, a.q, b.q FROM places a, places b WHERE a.q < b.q),
codes AS (SELECT CAST(unnest(range(1, 16)) AS INTEGER) AS code),
on_set AS (SELECT size, qa, qb, (CAST(code & 1 AS HUGEINT) << CAST(qa AS HUGEINT)) + (CAST((code >> 1) & 1 AS HUGEINT) << CAST(qa + 32 AS HUGEINT))
    + (CAST((code >> 2) & 1 AS HUGEINT) << CAST(qb AS HUGEINT)) + (CAST((code >> 3) & 1 AS HUGEINT) << CAST(qb + 32 AS HUGEINT)) AS w
  FROM small_sets, codes WHERE size = 2 OR code < 4),
judged AS (SELECT sample_seed, size, qa, qb, on_set.w, bit_xor(CASE WHEN (on_set.w >> CAST(piv AS HUGEINT)) & 1 = 1 THEN rref.w ELSE CAST(0 AS HUGEINT) END) = on_set.w AS in_span,
    max(bit_count(on_set.w & rref.w) % 2) = 0 AS orthogonal FROM rref, on_set GROUP BY sample_seed, size, qa, qb, on_set.w),
carriers AS (SELECT sample_seed, size FROM (SELECT sample_seed, size, qa, qb, count(*) FILTER (in_span) AS s, count(*) FILTER (orthogonal) AS o FROM judged GROUP BY 1, 2, 3, 4) WHERE s > o),
smallest AS (SELECT sample_seed, min(size) AS size FROM carriers GROUP BY 1)"""


@query(
    "distances_up_to_pairs",
    f"""WITH RECURSIVE {V.SIGNS_SQL}, {_rank_sql('vectors').replace('elim', 'elim0').replace('ranks', 'ranks0')}, {_arc_pairs_sql()},
        best AS (SELECT sample_seed, min(len) AS d FROM info WHERE start IN (0, 8, 16, 24) GROUP BY 1), {RREF_SQL}, {SMALL_SETS_SQL},
        arcs AS (SELECT sample_seed, k, CASE WHEN k = 0 THEN 0 ELSE coalesce(d, 32) END AS d_cont FROM total LEFT JOIN best USING (sample_seed))
        SELECT sample_seed, CAST(d_cont AS INTEGER) AS d_cont, CAST(CASE WHEN k = 0 THEN 0 WHEN size = 1 THEN 1 WHEN d_cont <= 1 THEN d_cont
          WHEN size = 2 THEN 2 ELSE d_cont END AS INTEGER) AS d_min FROM arcs LEFT JOIN smallest USING (sample_seed)""",
)
def distances_up_to_pairs(t: Tables) -> DataFrame:
    return dist.distances(_sign_spaces(t), KEY, max_exhaustive=2).select("sample_seed", "d_cont", "d_min")


@query("distances_signs")
def distances_signs(t: Tables) -> DataFrame:
    return dist.distances(_sign_spaces(t), KEY)


@query("distances_matrices")
def distances_matrices(t: Tables) -> DataFrame:
    return dist.distances(_matrix_spaces(t), KEY)


# Three vectors live on one column; a vector on a set is a sum of one or none for each of its columns.
SETS_SQL = """letters AS (SELECT q, code, CASE code WHEN 0 THEN CAST(0 AS HUGEINT) WHEN 1 THEN m WHEN 2 THEN m << CAST(32 AS HUGEINT) ELSE m + (m << CAST(32 AS HUGEINT)) END AS w
  FROM (SELECT q, CAST(1 AS HUGEINT) << CAST(q AS HUGEINT) AS m FROM (SELECT CAST(unnest(range(0, 32)) AS INTEGER) AS q)), (SELECT unnest(range(0, 4)) AS code)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_seed ORDER BY piv) - 1 AS j FROM rref),
letter AS (SELECT sample_seed, q, code, xor(any_value(l.w), bit_xor(CASE WHEN (l.w >> CAST(piv AS HUGEINT)) & 1 = 1 THEN r.w ELSE CAST(0 AS HUGEINT) END)) AS rest,
    CAST(sum(CASE WHEN bit_count(r.w & l.w) % 2 = 1 THEN CAST(1 AS HUGEINT) << CAST(j AS HUGEINT) ELSE 0 END) AS HUGEINT) AS dots
  FROM ranked r, letters l GROUP BY 1, 2, 3),
ones AS (SELECT sample_seed, [q] AS members FROM letter WHERE code > 0 GROUP BY sample_seed, q HAVING count(*) FILTER (rest = 0) > count(*) FILTER (dots = 0)),
twos AS (SELECT a.sample_seed, [a.q, b.q] AS members FROM letter a JOIN letter b ON a.sample_seed = b.sample_seed AND a.q < b.q
  GROUP BY a.sample_seed, a.q, b.q HAVING count(*) FILTER (a.rest = b.rest) > count(*) FILTER (a.dots = b.dots)),
open AS (SELECT DISTINCT sample_seed FROM letter WHERE sample_seed NOT IN (SELECT sample_seed FROM ones UNION SELECT sample_seed FROM twos)),
threes AS (SELECT a.sample_seed, [a.q, b.q, c.q] AS members FROM letter a JOIN open o ON o.sample_seed = a.sample_seed
  JOIN letter b ON a.sample_seed = b.sample_seed AND a.q < b.q JOIN letter c ON c.sample_seed = b.sample_seed AND b.q < c.q
  GROUP BY a.sample_seed, a.q, b.q, c.q HAVING count(*) FILTER (xor(a.rest, b.rest) = c.rest) > count(*) FILTER (xor(a.dots, b.dots) = c.dots)),
found AS (SELECT sample_seed, min(struct_pack(size := len(members), members := members)) AS x
  FROM (SELECT * FROM ones UNION ALL SELECT * FROM twos UNION ALL SELECT * FROM threes) GROUP BY 1)
SELECT d.sample_seed, CAST(x.size AS INTEGER) AS size, x.members AS members FROM dims d LEFT JOIN found USING (sample_seed)"""


@query("smallest_sets_signs", f"WITH RECURSIVE {V.SIGNS_SQL}, dims AS (SELECT DISTINCT sample_seed FROM vectors), {RREF_SQL}, {SETS_SQL}")
def smallest_sets_signs(t: Tables) -> DataFrame:
    return dist.smallest_sets(_sign_spaces(t), KEY)


@query("smallest_sets_matrices", f"WITH RECURSIVE {MATRIX_ROWS_SQL}, {RREF_SQL}, {SETS_SQL}")
def smallest_sets_matrices(t: Tables) -> DataFrame:
    return dist.smallest_sets(_matrix_spaces(t), KEY)


# ---------------------------------------------------------------- span membership and pure-type operators

SPAN_SQL = """cand AS (SELECT DISTINCT 3 * q + i AS v, (CASE WHEN vx = 1 THEN CAST(1 AS HUGEINT) << CAST(q AS HUGEINT) ELSE 0 END)
    + (CASE WHEN vz = 1 THEN CAST(1 AS HUGEINT) << CAST(q + 32 AS HUGEINT) ELSE 0 END) AS w
  FROM (SELECT DISTINCT q FROM entries), (VALUES (0, 1, 0), (1, 1, 1), (2, 0, 1)) AS types(i, vx, vz)),
hits AS (SELECT sample_seed, v, bit_xor(rref.w) AS s FROM rref JOIN cand ON (cand.w >> CAST(piv AS HUGEINT)) & 1 = 1 GROUP BY 1, 2),
span AS (SELECT d.sample_seed, cand.v, coalesce(hits.s, 0) = cand.w AS in_span FROM dims d CROSS JOIN cand
         LEFT JOIN hits ON hits.sample_seed = d.sample_seed AND hits.v = cand.v)"""


@query("row_span_members", f"WITH RECURSIVE {MATRIX_ROWS_SQL}, {RREF_SQL}, {SPAN_SQL} SELECT sample_seed, v, in_span FROM span")
def row_span_members(t: Tables) -> DataFrame:
    return gf2.row_span_members(_matrix_spaces(t), _packed_vectors(t), KEY)


@query(
    "row_span_lists",
    f"""WITH RECURSIVE {MATRIX_ROWS_SQL}, {RREF_SQL}, {SPAN_SQL} SELECT sample_seed, count(*) AS n_listed,
          coalesce(string_agg(v, ',' ORDER BY v) FILTER (in_span), '') AS in_span FROM span GROUP BY 1""",
)
def row_span_lists(t: Tables) -> DataFrame:
    """One row per matrix, only the vectors in the span are named."""
    found = gf2.span_lists(_matrix_spaces(t), _packed_vectors(t), KEY)
    return found.select("sample_seed", "n_listed", F.array_join(F.col("in_span").cast("array<string>"), ",").alias("in_span"))


def _packed_vectors(t: Tables) -> DataFrame:
    vectors = _single_vectors(t)
    bit = F.expr("shiftleft(1L, q)")
    words = F.array(F.when(F.col("vx") == 1, bit).otherwise(F.lit(0)), F.when(F.col("vz") == 1, bit).otherwise(F.lit(0)))
    return vectors.select("n_cols", "v", words.alias("words"))


PAIRS_SQL = """sets AS (SELECT 1 AS size, CAST(1 AS HUGEINT) << CAST(a AS HUGEINT) AS m FROM (SELECT CAST(unnest(range(0, 32)) AS INTEGER) AS a)
    UNION ALL SELECT 2, (CAST(1 AS HUGEINT) << CAST(a AS HUGEINT)) + (CAST(1 AS HUGEINT) << CAST(b AS HUGEINT))
    FROM (SELECT CAST(unnest(range(0, 32)) AS INTEGER) AS a), (SELECT CAST(unnest(range(0, 32)) AS INTEGER) AS b) WHERE a < b),
cand AS (SELECT size, i, m, CASE i WHEN 'x' THEN m WHEN 'z' THEN m << CAST(32 AS HUGEINT) ELSE m + (m << CAST(32 AS HUGEINT)) END AS w,
         CASE i WHEN 'z' THEN m WHEN 'x' THEN m << CAST(32 AS HUGEINT) ELSE m + (m << CAST(32 AS HUGEINT)) END AS dual
  FROM sets, (VALUES ('x'), ('y'), ('z')) AS types(i)),
hits AS (SELECT sample_seed, i, m, any_value(size) AS size, any_value(cand.w) AS w, any_value(dual) AS dual, bit_xor(rref.w) AS s
         FROM rref JOIN cand ON (cand.w >> CAST(piv AS HUGEINT)) & 1 = 1 GROUP BY 1, 2, 3),
members AS (SELECT * FROM hits WHERE s = w),
logical AS (SELECT DISTINCT e.sample_seed, e.i, e.size FROM members e JOIN rref v ON v.sample_seed = e.sample_seed
            WHERE bit_count(v.w & e.dual) % 2 = 1),
tops AS (SELECT sample_seed, i, min(size) AS d FROM logical GROUP BY 1, 2),
sizes AS (SELECT d.sample_seed, (SELECT count(*) FROM rref WHERE rref.sample_seed = d.sample_seed) - 32 AS k FROM dims d)"""


@query(
    "logical_weights_depth2",
    f"""WITH RECURSIVE {MATRIX_ROWS_SQL}, {RREF_SQL}, {PAIRS_SQL}, wide AS (SELECT sample_seed, any_value(k) AS k,
        coalesce(max(CASE WHEN i = 'x' THEN d END), 33) AS dx, coalesce(max(CASE WHEN i = 'y' THEN d END), 33) AS dy,
        coalesce(max(CASE WHEN i = 'z' THEN d END), 33) AS dz FROM sizes LEFT JOIN tops USING (sample_seed) GROUP BY 1)
        SELECT sample_seed, CAST(CASE WHEN k = 0 THEN 0 ELSE dx END AS INTEGER) AS d_logical_x, CAST(CASE WHEN k = 0 THEN 0 ELSE dy END AS INTEGER) AS d_logical_y,
        CAST(CASE WHEN k = 0 THEN 0 ELSE dz END AS INTEGER) AS d_logical_z, CAST(CASE WHEN k = 0 THEN 0 ELSE least(dx, dy, dz) END AS INTEGER) AS d_logical_min,
        CAST(CASE WHEN k = 0 THEN 0 ELSE 2 END AS INTEGER) AS search_depth,
        CASE WHEN k = 0 THEN 'trivial (k=0)' ELSE 'exhaustive_leq_2' END AS method FROM wide""",
)
def logical_weights_depth2(t: Tables) -> DataFrame:
    return dist.logical_weights(_matrix_spaces(t), KEY, max_exhaustive=2)


# Residuals of single columns modulo the rows and their clashes add up over sets, so halves of a set meet by residual.
HALVES_SQL = """types AS (SELECT * FROM (VALUES ('x'), ('y'), ('z')) AS t(i)),
single AS (SELECT i, q, CASE i WHEN 'x' THEN m WHEN 'z' THEN m << CAST(32 AS HUGEINT) ELSE m + (m << CAST(32 AS HUGEINT)) END AS w,
    CASE i WHEN 'z' THEN m WHEN 'x' THEN m << CAST(32 AS HUGEINT) ELSE m + (m << CAST(32 AS HUGEINT)) END AS dual
  FROM (SELECT q, CAST(1 AS HUGEINT) << CAST(q AS HUGEINT) AS m FROM (SELECT CAST(unnest(range(0, 32)) AS INTEGER) AS q)), types),
numbered AS (SELECT *, row_number() OVER (PARTITION BY sample_seed ORDER BY piv) - 1 AS j FROM rref),
one AS (SELECT sample_seed, i, q, xor(any_value(s.w), bit_xor(CASE WHEN (s.w >> CAST(piv AS HUGEINT)) & 1 = 1 THEN n.w ELSE CAST(0 AS HUGEINT) END)) AS rest,
    CAST(sum(CASE WHEN bit_count(n.w & dual) % 2 = 1 THEN CAST(1 AS HUGEINT) << CAST(j AS HUGEINT) ELSE 0 END) AS HUGEINT) AS clash
  FROM numbered n, single s GROUP BY 1, 2, 3),
half AS (SELECT DISTINCT sample_seed, i, 0 AS size, CAST(0 AS HUGEINT) AS rest, CAST(0 AS HUGEINT) AS clash FROM one
  UNION ALL SELECT sample_seed, i, 1, rest, clash FROM one
  UNION ALL SELECT a.sample_seed, a.i, 2, xor(a.rest, b.rest), xor(a.clash, b.clash) FROM one a JOIN one b ON a.sample_seed = b.sample_seed AND a.i = b.i AND a.q < b.q),
halved AS (SELECT DISTINCT * FROM half),
operators AS (SELECT a.sample_seed, a.i, min(a.size + b.size) AS d FROM halved a JOIN halved b
    ON a.sample_seed = b.sample_seed AND a.i = b.i AND a.rest = b.rest AND a.clash <> b.clash AND a.size >= b.size AND a.size - b.size <= 1 GROUP BY 1, 2),
sizes AS (SELECT d.sample_seed, (SELECT count(*) FROM rref WHERE rref.sample_seed = d.sample_seed) - 32 AS k FROM dims d),
wide AS (SELECT sample_seed, any_value(k) AS k, coalesce(max(CASE WHEN i = 'x' THEN d END), 33) AS dx, coalesce(max(CASE WHEN i = 'y' THEN d END), 33) AS dy,
    coalesce(max(CASE WHEN i = 'z' THEN d END), 33) AS dz FROM sizes LEFT JOIN operators USING (sample_seed) GROUP BY 1)"""


def _logical_sql(rows: str) -> str:
    return f"""WITH RECURSIVE {rows}, {RREF_SQL}, {HALVES_SQL}
        SELECT sample_seed, CAST(CASE WHEN k = 0 THEN 0 ELSE dx END AS INTEGER) AS d_logical_x, CAST(CASE WHEN k = 0 THEN 0 ELSE dy END AS INTEGER) AS d_logical_y,
        CAST(CASE WHEN k = 0 THEN 0 ELSE dz END AS INTEGER) AS d_logical_z, CAST(CASE WHEN k = 0 THEN 0 ELSE least(dx, dy, dz) END AS INTEGER) AS d_logical_min,
        CAST(CASE WHEN k = 0 THEN 0 ELSE 4 END AS INTEGER) AS search_depth,
        CASE WHEN k = 0 THEN 'trivial (k=0)' ELSE 'exhaustive_leq_4' END AS method FROM wide"""


@query("logical_weights", _logical_sql(MATRIX_ROWS_SQL))
def logical_weights(t: Tables) -> DataFrame:
    """Lightest operators of all matrices at the default depth."""
    return dist.logical_weights(_matrix_spaces(t), KEY)


@query("logical_weights_signs", _logical_sql(V.SIGNS_SQL + ", dims AS (SELECT DISTINCT sample_seed FROM vectors)"))
def logical_weights_signs(t: Tables) -> DataFrame:
    return dist.logical_weights(_sign_spaces(t), KEY)


@query("logical_weights_bounded")
def logical_weights_bounded(t: Tables) -> DataFrame:
    spaces = _matrix_spaces(t)
    bounds = dist.contiguous_distance(spaces, KEY).select("sample_seed", "d_cont")
    return dist.logical_weights(spaces, KEY, bounds)
