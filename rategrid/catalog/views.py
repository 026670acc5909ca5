"""The driver's tables seen as sweep data, in Spark and as SQL text for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rategrid.catalog.base import Tables
from rategrid.operators.ranks import ordered_index

# ---------------------------------------------------------------- samples and analyses

SAMPLES_SQL = """samples AS (
  SELECT l_returnflag AS run_id, l_linenumber AS n, l_discount AS p, l_orderkey AS sample_seed,
         greatest(CAST(l_quantity AS INTEGER) - 10, 0) AS k,
         CASE WHEN CAST(l_quantity AS INTEGER) > 10 THEN 1 ELSE 0 END AS p_k_gt_0,
         l_extendedprice AS tmi, l_tax AS entropy_half_cut,
         CAST(l_suppkey % 40 AS DOUBLE) / 4 AS final_abar, l_extendedprice / 1000 AS runtime_total_s
  FROM lineitem)"""


def samples(t: Tables) -> DataFrame:
    """``lineitem`` as a samples table: one run per return flag."""
    k = F.greatest(F.col("l_quantity").cast("int") - 10, F.lit(0))
    return t.lineitem.select(
        F.col("l_returnflag").alias("run_id"),
        F.col("l_linenumber").alias("n"),
        F.col("l_discount").alias("p"),
        F.col("l_orderkey").alias("sample_seed"),
        F.struct(
            k.alias("k"),
            F.when(k > 0, 1).otherwise(0).cast("smallint").alias("p_k_gt_0"),
            F.col("l_extendedprice").alias("tmi"),
            F.col("l_tax").alias("entropy_half_cut"),
        ).alias("obs"),
        F.struct(
            ((F.col("l_suppkey") % 40).cast("double") / 4).alias("final_abar"),
            (F.col("l_extendedprice") / 1000).alias("runtime_total_s"),
        ).alias("diag"),
    )


TRAPS_SQL = """traps AS (
  SELECT l_linenumber AS n, l_discount AS p, CASE WHEN l_suppkey % 19 = 0 THEN NULL WHEN l_suppkey % 11 = 0 THEN 'NaN'::DOUBLE
         WHEN l_suppkey % 13 = 0 THEN 'Infinity'::DOUBLE WHEN l_suppkey % 17 = 0 THEN '-Infinity'::DOUBLE ELSE l_extendedprice END AS y
  FROM lineitem)"""


def traps(t: Tables) -> DataFrame:
    """``lineitem`` as samples whose value is null, NaN or infinite for some suppliers."""
    value = F.when(F.col("l_suppkey") % 19 == 0, F.lit(None))
    for step, trap in ((11, "NaN"), (13, "Infinity"), (17, "-Infinity")):
        value = value.when(F.col("l_suppkey") % step == 0, F.lit(float(trap)))
    return t.lineitem.select(
        F.col("l_linenumber").alias("n"), F.col("l_discount").alias("p"), value.otherwise(F.col("l_extendedprice")).alias("y")
    )


DISTANCES_SQL = """distances AS (
  SELECT o_orderkey AS sample_seed, CAST(floor(o_totalprice / 1000) AS INTEGER) AS d_cont,
         CAST(o_custkey % 5 AS INTEGER) AS d_min
  FROM orders WHERE o_orderstatus = 'F')"""


def distances(t: Tables) -> DataFrame:
    """Finished ``orders`` as an analysis table: one row per sample seed, not for all seeds."""
    return t.orders.where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("sample_seed"),
        F.struct(
            F.floor(F.col("o_totalprice") / 1000).cast("int").alias("d_cont"),
            (F.col("o_custkey") % 5).cast("int").alias("d_min"),
        ).alias("distances"),
    )


# ---------------------------------------------------------------- timing records

TIMINGS_SQL = """timings AS (
  SELECT CASE WHEN l_linestatus = 'O' THEN 'NN' ELSE 'ATA' END AS model,
         8 * l_linenumber AS n, l_discount AS p, l_orderkey AS seed,
         l_extendedprice / 1000 AS time, CAST(l_quantity AS INTEGER) // 10 AS k,
         CAST(l_suppkey % 40 AS DOUBLE) / 4 AS abar
  FROM lineitem)"""


def timings(t: Tables) -> DataFrame:
    """``lineitem`` as benchmark records of two models."""
    return t.lineitem.select(
        F.when(F.col("l_linestatus") == "O", "NN").otherwise("ATA").alias("model"),
        (8 * F.col("l_linenumber")).alias("n"),
        F.col("l_discount").alias("p"),
        F.col("l_orderkey").alias("seed"),
        (F.col("l_extendedprice") / 1000).alias("time"),
        F.floor(F.col("l_quantity") / 10).cast("int").alias("k"),
        ((F.col("l_suppkey") % 40).cast("double") / 4).alias("abar"),
    )

# ---------------------------------------------------------------- curves over a rate grid

GRID_SQL = """grid_samples AS (
  SELECT o_orderpriority AS run_id, CAST(o_custkey % 3 AS INTEGER) + 1 AS n,
         CASE WHEN o_custkey % 3 = 2 THEN month(o_orderdate) + 0.5 ELSE month(o_orderdate) END / 100 AS p,
         CASE WHEN o_totalprice > 245000 THEN 1 ELSE 0 END AS k
  FROM orders)"""


def grid_samples(t: Tables) -> DataFrame:
    """``orders`` as samples on a monthly rate grid; the largest size has a shifted grid."""
    month = F.month("o_orderdate").cast("double")
    size = (F.col("o_custkey") % 3).cast("int")
    return t.orders.select(
        F.col("o_orderpriority").alias("run_id"),
        (size + 1).alias("n"),
        (F.when(size == 2, month + 0.5).otherwise(month) / 100).alias("p"),
        F.when(F.col("o_totalprice") > 245000, 1).otherwise(0).alias("k"),
    )


# ---------------------------------------------------------------- time series

TRACE_SQL = """trace AS (
  SELECT CAST(user_id % 4 AS INTEGER) + 1 AS n, CAST(user_id % 5 AS DOUBLE) / 10 AS p, user_id AS sample_seed,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
         CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS s
  FROM events)"""


def event_trace(t: Tables) -> DataFrame:
    """``events`` as one time series per user: the t-th event, zero where it is an error."""
    rows = t.events.select(
        ((F.col("user_id") % 4).cast("int") + 1).alias("n"),
        ((F.col("user_id") % 5).cast("double") / 10).alias("p"),
        F.col("user_id").alias("sample_seed"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("s"),
        "ts",
        "event_id",
    )
    placed = ordered_index(rows, ["sample_seed"], ["ts", "event_id"], F.date_trunc("hour", "ts"), "t")
    return placed.select("n", "p", "sample_seed", "t", "s")


BITS_SQL = """bit_traces AS (
  SELECT CAST(o_custkey % 3 AS INTEGER) + 1 AS n, month(o_orderdate) / 100 AS p, o_orderkey AS sample_seed,
         4 + o_custkey % 4 AS last_t, o_orderkey AS bits FROM orders),
bit_rows AS (
  SELECT n, p, sample_seed, t, CASE WHEN t > last_t THEN 0 ELSE (bits >> t) & 1 END AS s
  FROM bit_traces, (SELECT unnest(range(0, 9)) AS t) AS steps)"""


def bit_traces(t: Tables) -> DataFrame:
    """``orders`` as early-stopped traces in array form: the low bits of the order key."""
    last = 4 + (F.col("o_custkey") % 4)
    return t.orders.select(
        ((F.col("o_custkey") % 3).cast("int") + 1).alias("n"),
        (F.month("o_orderdate") / 100).alias("p"),
        F.col("o_orderkey").alias("sample_seed"),
        F.transform(
            F.sequence(F.lit(0), last.cast("int")), lambda i: F.getbit(F.col("o_orderkey"), i).cast("int")
        ).alias("s"),
    )

# ---------------------------------------------------------------- binary matrices

N_COLS, N_ROWS = 32, 64

MATRIX_SQL = f"""dims AS (SELECT s_suppkey AS sample_seed, {N_COLS} AS n_cols, {N_ROWS} AS n_rows FROM supplier),
entries AS (SELECT l_suppkey AS sample_seed, CAST(l_orderkey % {N_ROWS} AS INTEGER) AS r, CAST(l_partkey % {N_COLS} AS INTEGER) AS q,
    max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS x, max(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS z
  FROM lineitem GROUP BY 1, 2, 3)"""


def matrix_dims(t: Tables) -> DataFrame:
    """One 64 x 32 matrix per supplier."""
    return t.supplier.select(
        F.col("s_suppkey").alias("sample_seed"), F.lit(N_COLS).alias("n_cols"), F.lit(N_ROWS).alias("n_rows")
    )


def matrix_entries(t: Tables) -> DataFrame:
    """Line items as non-zero entries: x for returned ones, z for the others.

    Grouped by column with a bit per row, so the grouping holds columns and not entries; a block is 64 rows.
    """
    # a row number that is null has the first bit of a block that is null
    bit = F.expr("shiftleft(1L, cast(coalesce(pmod(r, 64), 0) as int))")
    place = t.lineitem.select(
        F.col("l_suppkey").alias("sample_seed"),
        (F.col("l_orderkey") % N_ROWS).cast("int").alias("r"),
        (F.col("l_partkey") % N_COLS).cast("int").alias("q"),
        F.coalesce(F.col("l_returnflag") == "R", F.lit(False)).alias("returned"),
    )
    columns = place.groupBy("sample_seed", "q", F.floor(F.col("r") / 64).cast("int").alias("block")).agg(
        F.coalesce(F.bit_or(F.when(F.col("returned"), bit)), F.lit(0).cast("bigint")).alias("xs"),
        F.coalesce(F.bit_or(F.when(~F.col("returned"), bit)), F.lit(0).cast("bigint")).alias("zs"),
    )
    rows = columns.select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    x, z = (F.getbit(c, F.col("i")).cast("int") for c in ("xs", "zs"))
    entries = rows.select("sample_seed", (F.col("block") * 64 + F.col("i")).alias("r"), "q", x.alias("x"), z.alias("z"))
    return entries.where("x = 1 or z = 1")


SIGNS_SQL = """vectors AS (
  SELECT label AS sample_seed, vec_id AS r,
         list_sum(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS HUGEINT) << CAST(i AS HUGEINT) ELSE 0 END)) AS w
  FROM embeddings)"""


def sign_rows(t: Tables) -> DataFrame:
    """Embedding signs as packed rows: dimensions 0-31 are x bits, 32-63 are z bits."""

    def word(first: int):
        return F.expr(
            f"aggregate(sequence(0, 31), 0L, (w, i) -> w | if(embedding[i + {first}] > 0, shiftleft(1L, i), 0L))"
        )

    return t.embeddings.select(F.col("label").alias("sample_seed"), F.array(word(0), word(32)).alias("words"))


def sign_dims(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("label").alias("sample_seed")).distinct().select("sample_seed", F.lit(32).alias("n_cols"))
