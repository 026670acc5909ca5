"""Names of partitions, runs, statistics and table cells, built from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size_dir(n: Column) -> Column:
    return F.format_string("n=%04d", n.cast("int"))


def rate_dir(p: Column) -> Column:
    return F.format_string("p=%.4f", p.cast("double"))


def cell_path(n: Column, p: Column) -> Column:
    return F.concat_ws("/", size_dir(n), rate_dir(p))


def partition_value(part: Column) -> Column:
    """The text after ``=`` in a ``key=value`` folder name."""
    return F.split_part(part, F.lit("="), F.lit(2))


def quantile_suffix(q: float) -> str:
    return f"q{int(round(q * 1000)):03d}"


# Spelling of comparison operators inside column names.
OPERATOR_NAMES = {">": "gt", "<": "lt", "=": "eq", "!": "ne", " ": ""}


def condition_suffix(column: str, text: str) -> str:
    spelled = "".join(OPERATOR_NAMES.get(ch, ch) for ch in text)
    return column.replace(".", "_") + spelled


# Short codes used in run ids.
GRAPH_CODES = {"cycle": "NN", "complete": "ATA"}
DEPTH_CODES = {"O(n)": "On", "O(log_n)": "Ologn"}


def _coded(column: Column, codes: dict[str, str], otherwise: Column) -> Column:
    result = otherwise
    for value, code in codes.items():
        result = F.when(column == value, F.lit(code)).otherwise(result)
    return result


def config_slug(graph: Column, matching: Column, measurement: Column, depth: Column) -> Column:
    return F.concat_ws(
        "-",
        _coded(graph, GRAPH_CODES, graph),
        matching,
        measurement,
        _coded(depth, DEPTH_CODES, F.lit("depth")),
    )


def config_digest(config_json: Column) -> Column:
    """First seven hex digits of the SHA-1 of a configuration in JSON."""
    return F.substring(F.sha1(config_json), 1, 7)


def run_id(day: Column, slug: Column, revision: Column, config_json: Column) -> Column:
    return F.concat(day, F.lit("_"), slug, F.lit("__"), F.coalesce(revision, config_digest(config_json)))


def utc_stamp() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def mean_pm_sem(mean: Column, error: Column, missing: str = "---") -> Column:
    """``mean +- error`` to three decimals; only the mean if the error is unknown."""
    no_mean = mean.isNull() | F.isnan(mean)
    no_error = error.isNull() | F.isnan(error)
    plain = F.format_string("%.3f", mean)
    both = F.format_string("%.3f ± %.3f", mean, error)
    return F.when(no_mean, F.lit(missing)).when(no_error, plain).otherwise(both)


# Characters that typeset tables need escaped.
TEX_SPECIAL = "&%_#$"


def tex_escape(text: Column) -> Column:
    """Escape for a typeset table: backslashes become a command, specials get a backslash."""
    out = F.replace(text, F.lit("\\"), F.lit("\\textbackslash{}"))
    return F.regexp_replace(out, "([" + TEX_SPECIAL + "{}])", "\\\\$1")
