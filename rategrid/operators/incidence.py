"""Statistics of many sparse binary matrices stored as one incidence relation.

``incidence(keys, r, q, x, z)`` has one row per non-zero entry; ``dims(keys, n_cols,
n_rows)`` has one row per matrix.  Rows and columns without entries never appear as rows:
they enter every mean, variance, minimum and histogram through the counts in ``dims``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rategrid.functions.columns import attach_summary

FLAT = 1e-15


def pauli_code(x: Column, z: Column) -> Column:
    return (2 * x + z).cast("tinyint")


def pauli_label(x: Column, z: Column) -> Column:
    return F.when((x == 1) & (z == 1), "Y").when(x == 1, "X").otherwise("Z")


def row_role(r: Column, n_cols: Column) -> Column:
    return F.when(r >= n_cols, "stabilizer").otherwise("destabilizer")


def stabilizer_rows(incidence: DataFrame, dims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries of the rows with index ``n_cols`` and up."""
    return incidence.join(dims.select(*keys, "n_cols"), list(keys)).where("r >= n_cols").drop("n_cols")


def marginal(incidence: DataFrame, keys: Sequence[str], axis: str) -> DataFrame:
    """Entries and X entries per row (``axis='r'``) or per column (``axis='q'``)."""
    return incidence.groupBy(*keys, axis).agg(
        F.count(F.lit(1)).alias("weight"), F.sum(F.col("x").cast("bigint")).alias("x_weight")
    )


def marginals(incidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row and column marginals in one pass: ``axis`` is ``r`` or ``q``, ``member`` the index."""
    ends = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("member")) for a in ("q", "r")])
    entries = incidence.select(*keys, "x", F.explode(ends).alias("_e"))
    return entries.groupBy(*keys, F.col("_e.axis").alias("axis"), F.col("_e.member").alias("member")).agg(
        F.count(F.lit(1)).alias("weight"), F.sum(F.col("x").cast("bigint")).alias("x_weight")
    )


def _power_sums(prefix: str, axis: str) -> list[Column]:
    w = F.when(F.col("axis") == axis, F.col("weight").cast("double"))
    return [
        F.count(w).alias(f"_{prefix}m"),
        F.sum(w).alias(f"_{prefix}1"),
        F.sum(w * w).alias(f"_{prefix}2"),
        F.sum(w * w * w).alias(f"_{prefix}3"),
        F.max(w).alias(f"_{prefix}max"),
        F.min(w).alias(f"_{prefix}min"),
    ]


def _moments(prefix: str, members: Column, mean_name: str, tag: str) -> list[Column]:
    """Population moments over all members, absent ones counting as zero."""
    size = members.cast("double")
    s1, s2, s3 = (F.coalesce(F.col(f"_{prefix}{i}"), F.lit(0.0)) for i in (1, 2, 3))
    mean = s1 / size
    variance = F.greatest(s2 / size - mean * mean, F.lit(0.0))
    deviation = F.sqrt(variance)
    third = s3 / size - 3 * mean * s2 / size + 2 * mean * mean * mean
    present = F.coalesce(F.col(f"_{prefix}m"), F.lit(0))
    return [
        mean.alias(mean_name),
        variance.alias(f"var_{tag}"),
        deviation.alias(f"std_{tag}"),
        F.when(mean > 0, deviation / mean).otherwise(F.lit(0.0)).alias(f"cv_{tag}"),
        F.coalesce(F.col(f"_{prefix}max"), F.lit(0)).cast("double").alias(f"{tag}_max"),
        F.when(present < members, 0).otherwise(F.col(f"_{prefix}min")).cast("double").alias(f"{tag}_min"),
        F.when(deviation > FLAT, third / (deviation * deviation * deviation)).otherwise(F.lit(0.0)).alias(f"skew_{tag}"),
    ]


def weight_stats(incidence: DataFrame, dims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All scalar weight observables, one row per matrix."""
    keys = list(keys)
    is_row = F.col("axis") == "r"
    lower = F.col("member") >= F.col("n_cols")
    sums = (
        marginals(incidence, keys)
        .join(dims.select(*keys, "n_cols"), keys)
        .groupBy(*keys)
        .agg(
            *_power_sums("a", "q"),
            *_power_sums("w", "r"),
            F.sum(F.when(is_row & lower, F.col("weight"))).alias("_stab"),
            F.sum(F.when(is_row & ~lower, F.col("weight"))).alias("_destab"),
            F.sum(F.when(is_row, F.col("x_weight"))).alias("_x"),
        )
    )
    joined = dims.join(sums, keys, "left")
    n, rows = F.col("n_cols"), F.col("n_rows")
    zero = F.lit(0)
    stats = joined.select(
        *keys,
        *_moments("a", n, "abar", "a"),
        *_moments("w", rows, "wbar", "w"),
        (F.coalesce(F.col("_stab"), zero) / n).alias("wbar_stab"),
        (F.coalesce(F.col("_destab"), zero) / n).alias("wbar_destab"),
        (F.coalesce(F.col("_x"), zero) / rows).alias("mean_wt_x"),
        F.coalesce(F.col("_a1"), F.lit(0.0)).alias("weight_mass"),
        (F.coalesce(F.col("_a1"), F.lit(0.0)) == F.coalesce(F.col("_w1"), F.lit(0.0))).alias("identity_holds"),
    )
    return stats.join(pivot_effectiveness(incidence, dims, keys), keys)


def pivot_effectiveness(incidence: DataFrame, dims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lightest and heaviest X row per column, averaged over columns, and their ratio."""
    keys = list(keys)
    # at most n_cols entries share a row, so the window partitions are small
    row = Window.partitionBy(*keys, "r")
    weighted = incidence.select(*keys, "q", "x", F.count(F.lit(1)).over(row).alias("weight"))
    per_column = (
        weighted.where("x = 1")
        .groupBy(*keys, "q")
        .agg(F.min("weight").alias("_light"), F.max("weight").alias("_heavy"))
    )
    sums = per_column.groupBy(*keys).agg(
        F.sum("_light").alias("_light"), F.sum("_heavy").alias("_heavy"), F.count(F.lit(1)).alias("_active")
    )
    joined = dims.join(sums, keys, "left")
    light = F.coalesce(F.col("_light"), F.lit(0)) / F.col("n_cols")
    heavy = F.coalesce(F.col("_heavy"), F.lit(0)) / F.col("n_cols")
    return joined.select(
        *keys,
        light.alias("pei_proxy"),
        heavy.alias("wcp_proxy"),
        F.when(light > 0, heavy / light).otherwise(F.lit(1.0)).alias("pivot_speedup"),
        F.coalesce(F.col("_active"), F.lit(0)).cast("bigint").alias("n_anticommuting_qubits"),
    )


def active_count(incidence: DataFrame, dims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean entries per column."""
    totals = incidence.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    return dims.join(totals, list(keys), "left").select(
        *keys, (F.coalesce(F.col("_m"), F.lit(0)) / F.col("n_cols")).alias("abar")
    )


def weight_pmf(
    incidence: DataFrame, dims: DataFrame, keys: Sequence[str], axis: str, value: str = "weight"
) -> DataFrame:
    """Share of rows or columns per weight, the zero bin included; other bins only if hit."""
    keys = list(keys)
    size = "n_cols" if axis == "q" else "n_rows"
    hit = marginal(incidence, keys, axis).where(F.col(value) > 0)
    bins = hit.groupBy(*keys, F.col(value).alias("bin")).agg(F.count(F.lit(1)).alias("members"))
    used = bins.groupBy(*keys).agg(F.sum("members").alias("_used"))
    empty = (
        dims.join(used, keys, "left")
        .select(*keys, F.lit(0).cast("bigint").alias("bin"), (F.col(size) - F.coalesce(F.col("_used"), F.lit(0))).alias("members"))
        .where("members > 0")
    )
    sized = bins.unionByName(empty).join(dims.select(*keys, size), keys)
    return sized.select(*keys, "bin", (F.col("members") / F.col(size)).alias("share"))


def audit_identity(columns: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Compare totals of separately stored column and row marginals, for all and X entries."""
    keys = list(keys)

    def totals(table: DataFrame, side: str) -> DataFrame:
        return table.groupBy(*keys).agg(
            F.sum("weight").alias(f"total_{side}"), F.sum("x_weight").alias(f"total_x_{side}")
        )

    both = totals(columns, "columns").join(totals(rows, "rows"), keys, "full_outer")
    names = [f"total{part}_{side}" for part in ("", "_x") for side in ("columns", "rows")]
    both = both.select(*keys, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names])
    return both.select(
        "*",
        (F.col("total_columns") == F.col("total_rows")).alias("total_pass"),
        (F.col("total_x_columns") == F.col("total_x_rows")).alias("x_pass"),
    )


def require_identity(audit: DataFrame) -> None:
    """Raise with the first failing matrices of an audit."""
    bad = audit.where("not (total_pass and x_pass)").limit(5).collect()
    if bad:
        raise AssertionError(f"column and row totals differ: {bad}")


def weight_spectrum(incidence: DataFrame, dims: DataFrame, keys: Sequence[str], value: str = "weight") -> DataFrame:
    """All row weights of each matrix as one array, row 0 first, zeros included."""
    keys = list(keys)
    held = marginal(incidence, keys, "r").groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("r", value))).alias("_w")
    )
    empty = F.coalesce(F.col("_w"), F.create_map().cast("map<int,bigint>"))
    joined = dims.join(held, keys, "left").withColumn("_w", empty)
    weights = F.transform(
        F.sequence(F.lit(0), F.col("n_rows") - 1), lambda r: F.coalesce(F.col("_w")[r], F.lit(0)).cast("int")
    )
    return joined.select(*keys, weights.alias("weights"))


def spectrum_rows(spectrum: DataFrame, keys: Sequence[str]) -> DataFrame:
    return spectrum.select(*keys, F.posexplode("weights").alias("r", "weight"))


def bipartite_edges(incidence: DataFrame, dims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges between columns and rows with Pauli label and row role."""
    sized = incidence.join(dims.select(*keys, "n_cols"), list(keys))
    return sized.select(
        *keys, "q", "r", pauli_label(F.col("x"), F.col("z")).alias("label"), row_role(F.col("r"), F.col("n_cols")).alias("role")
    )


def bipartite_nodes(incidence: DataFrame, dims: DataFrame, keys: Sequence[str], all_rows: bool = True) -> DataFrame:
    """Every column and row node with its degree; without ``all_rows`` only stabilizer rows."""
    keys = list(keys)
    kept = incidence if all_rows else stabilizer_rows(incidence, dims, keys)
    first = F.lit(0) if all_rows else F.col("n_cols")
    columns = dims.select(*keys, F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("node"), F.lit("column").alias("role"))
    rows = dims.select(*keys, "n_cols", F.explode(F.sequence(first, F.col("n_rows") - 1)).alias("node")).select(
        *keys, "node", row_role(F.col("node"), F.col("n_cols")).alias("role")
    )
    parts = []
    for nodes, axis in ((columns, "q"), (rows, "r")):
        degrees = marginal(kept, keys, axis).select(*keys, F.col(axis).alias("node"), F.col("weight").alias("degree"))
        parts.append(nodes.join(degrees, [*keys, "node"], "left"))
    return parts[0].unionByName(parts[1]).withColumn("degree", F.coalesce(F.col("degree"), F.lit(0)))


def hyperedges(incidence: DataFrame, dims: DataFrame, keys: Sequence[str], all_rows: bool = True) -> DataFrame:
    """Per row: its columns, the label of each, role and weight; empty rows are kept."""
    keys = list(keys)
    labelled = F.struct("q", pauli_label(F.col("x"), F.col("z")).alias("label"))
    edges = incidence.groupBy(*keys, "r").agg(F.array_sort(F.collect_list(labelled)).alias("_e"))
    first = F.lit(0) if all_rows else F.col("n_cols")
    rows = dims.select(*keys, "n_cols", F.explode(F.sequence(first, F.col("n_rows") - 1)).alias("r"))
    joined = rows.join(edges, [*keys, "r"], "left")
    none = F.array().cast("array<struct<q:int,label:string>>")
    entries = F.coalesce(F.col("_e"), none)
    return joined.select(
        *keys,
        "r",
        F.transform(entries, lambda e: e["q"]).alias("columns"),
        F.map_from_entries(entries).alias("labels"),
        row_role(F.col("r"), F.col("n_cols")).alias("role"),
        F.size(entries).alias("weight"),
    )


def bandwidth(incidence: DataFrame, dims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest row extent on the ring: size minus the largest gap between neighbours.

    Rows with fewer than two entries do not count; a matrix without other rows has 0.
    """
    keys = list(keys)
    along = Window.partitionBy(*keys, "r").orderBy("q")
    gaps = incidence.select(*keys, "r", "q", (F.col("q") - F.lag("q").over(along)).alias("_gap"))
    ends = gaps.groupBy(*keys, "r").agg(
        F.max("_gap").alias("_gap"), F.min("q").alias("_first"), F.max("q").alias("_last"), F.count(F.lit(1)).alias("_m")
    )
    sized = ends.where("_m > 1").join(dims.select(*keys, "n_cols"), keys)
    wrap = F.pmod(F.col("_first") + F.col("n_cols") - F.col("_last"), F.col("n_cols"))
    widest = sized.groupBy(*keys).agg(F.max(F.col("n_cols") - F.greatest(F.col("_gap"), wrap)).alias("_bw"))
    return dims.join(widest, keys, "left").select(*keys, F.coalesce(F.col("_bw"), F.lit(0)).cast("int").alias("bandwidth"))


# ------------------------------------------------------------------ packed words


def pack_rows(incidence: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """One row per matrix row: ``words`` holds the x bits, then the z bits, 64 per word."""
    count = (width + 63) // 64

    def word(bit: str, index: int) -> Column:
        here = (F.col(bit) == 1) & (F.floor(F.col("q") / 64) == index)
        shifted = F.expr(f"shiftleft(1L, cast(q - {64 * index} as int))")
        return F.coalesce(F.bit_or(F.when(here, shifted)), F.lit(0).cast("bigint"))

    words = F.array(*[word(bit, i) for bit in ("x", "z") for i in range(count)])
    return incidence.groupBy(*keys, "r").agg(words.alias("words"))


def unpack_rows(packed: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """The non-zero entries of packed rows."""
    count = (width + 63) // 64
    entries = packed.select(*keys, "r", "words", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("q"))

    def bit(offset: int) -> Column:
        word = F.get(F.col("words"), F.floor(F.col("q") / 64).cast("int") + offset)
        return F.getbit(word, F.pmod(F.col("q"), F.lit(64))).cast("int")

    return entries.select(*keys, "r", "q", bit(0).alias("x"), bit(count).alias("z")).where("x = 1 or z = 1")


def packed_weight(words: Column) -> Column:
    """Entries in a packed row: set bits of ``x | z``."""
    half = (F.size(words) / 2).cast("int")
    merged = F.zip_with(F.slice(words, F.lit(1), half), F.slice(words, half + 1, half), lambda x, z: x.bitwiseOR(z))
    return F.aggregate(merged, F.lit(0), lambda total, w: total + F.bit_count(w))


def xor_rows(packed: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    """Sum of the packed rows of each group over GF(2)."""
    count = 2 * ((width + 63) // 64)
    return packed.groupBy(*by).agg(F.array(*[F.bit_xor(F.get("words", F.lit(i))) for i in range(count)]).alias("words"))


def xor_columns(incidence: DataFrame, keys: Sequence[str], groups: DataFrame) -> DataFrame:
    """Sum of columns over GF(2): ``groups(q, g)`` names the target of each column."""
    sums = attach_summary(incidence, groups, ["q"]).groupBy(*keys, "r", "g").agg(
        (F.sum("x") % 2).cast("int").alias("x"), (F.sum("z") % 2).cast("int").alias("z")
    )
    return sums.where("x = 1 or z = 1").withColumnRenamed("g", "q")


def restrict_columns(incidence: DataFrame, keys: Sequence[str], subset: DataFrame) -> DataFrame:
    """Entries of ``[X_A | Z_A]`` for each subset: column ``pos`` for x, ``pos + size`` for z.

    ``subset(subset_id, q, pos, size)`` lists each member once.
    """
    joined = attach_summary(incidence, subset, ["q"])
    columns = F.array_compact(
        F.array(
            F.when(F.col("x") == 1, F.col("pos")), F.when(F.col("z") == 1, F.col("pos") + F.col("size"))
        )
    )
    return joined.select(*keys, "subset_id", "r", F.explode(columns).alias("c"))


def clashing(incidence: DataFrame, dims: DataFrame, vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per matrix and vector that share a column: the number of rows the vector does not commute with.

    Rows are summed 64 at a time: a word per column holds a bit for each row of a block, so neither entries nor their
    products with vectors are grouped one by one.
    """
    keys = list(keys)
    bit = F.expr("shiftleft(1L, cast(coalesce(pmod(r, 64), 0) as int))")
    # zero bits where a block has none, so each word is a number
    words = [F.coalesce(F.bit_xor(F.when(F.col(c) % 2 != 0, bit)), F.lit(0).cast("bigint")).alias(f"_{c}") for c in ("x", "z")]
    blocks = incidence.groupBy(*keys, "q", F.floor(F.col("r") / 64).alias("_block")).agg(*words)
    sized = blocks.join(dims.select(*keys, "n_cols").distinct(), keys)
    none = F.lit(0).cast("bigint")
    met = F.when(F.col("vz") % 2 != 0, F.col("_x")).otherwise(none).bitwiseXOR(F.when(F.col("vx") % 2 != 0, F.col("_z")).otherwise(none))
    per_block = attach_summary(sized, vectors, ["n_cols", "q"]).groupBy(*keys, "v", "_block").agg(F.bit_xor(met).alias("_odd"))
    return per_block.groupBy(*keys, "v").agg(F.sum(F.bit_count("_odd")).alias("clashes"))


def commutation(incidence: DataFrame, dims: DataFrame, vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per matrix and vector: does the vector commute with every row?

    ``vectors(n_cols, v, q, vx, vz)`` lists the non-zero entries of each vector.  Products
    are formed only where a row and a vector share a column; all other rows commute.
    """
    keys = list(keys)
    clashes = clashing(incidence, dims, vectors, keys)
    names = vectors.select("n_cols", "v").distinct()
    every = attach_summary(dims.select(*keys, "n_cols"), names, ["n_cols"]).drop("n_cols")
    joined = every.join(clashes, [*keys, "v"], "left")
    clash = F.coalesce(F.col("clashes"), F.lit(0)).cast("bigint")
    return joined.select(*keys, "v", clash.alias("clashes"), (clash == 0).alias("commutes"))


VECTORS_PER_LIST = 4096


def commutation_lists(incidence: DataFrame, dims: DataFrame, vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As :func:`commutation`, one row per matrix and list of vectors: ``n_listed`` and the exceptions in ``clashing``.

    ``clashing`` has ``(v, clashes)`` of the vectors that fail to commute with some row, by ``v``.  Vectors are dealt to
    lists of about ``VECTORS_PER_LIST`` by a hash, so no row holds more than that many exceptions.
    """
    keys = list(keys)
    names = vectors.select("n_cols", "v").distinct()
    part = F.pmod(F.xxhash64("v"), F.lit(-(-names.count() // VECTORS_PER_LIST) or 1)).alias("list_id")
    sizes = names.groupBy("n_cols", part).agg(F.count(F.lit(1)).alias("n_listed"))
    every = attach_summary(dims.select(*keys, "n_cols"), sizes, ["n_cols"]).drop("n_cols")
    odd = clashing(incidence, dims, vectors, keys).where("clashes > 0")
    found = odd.groupBy(*keys, part).agg(F.array_sort(F.collect_list(F.struct("v", "clashes"))).alias("clashing"))
    joined = every.join(found, [*keys, "list_id"], "left")
    none = F.array().cast(found.schema["clashing"].dataType)
    return joined.select(*keys, "list_id", "n_listed", F.coalesce("clashing", none).alias("clashing"))
