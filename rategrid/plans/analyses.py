"""The built-in analyses, as plug-ins over stored matrices and samples."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rategrid.operators import cellstats, distances, gf2, incidence
from rategrid.plans.registry import Analysis, register_analysis
from rategrid.session import cut_lineage
from rategrid.sources.runs import SAMPLE_KEY, attach_analyses

KEY = list(SAMPLE_KEY)


@dataclass
class Context:
    """Input of one analysis: matrices of the cells to compute, samples, earlier outputs."""

    entries: DataFrame
    dims: DataFrame
    samples: DataFrame | None = None
    outputs: dict[str, DataFrame] = field(default_factory=dict)
    width: int | None = None

    @cached_property
    def spaces(self) -> DataFrame:
        """Reduced row spaces, computed once and shared by the analyses that need them."""
        width = self.width or self.dims.agg(F.max("n_cols")).first()[0] or 1
        packed = incidence.pack_rows(self.entries, KEY, width)
        return cut_lineage(gf2.row_spaces(packed, self.dims, KEY))

    def limited(self, cells: DataFrame) -> Context:
        """The same context for the given cells only."""
        on = ["run_id", "n", "p"]
        spots = cells.select(*on).distinct()
        part = Context(
            self.entries.join(spots, on, "left_semi"),
            self.dims.join(spots, on, "left_semi"),
            self.samples,
            self.outputs,
            self.width,
        )
        if "spaces" in self.__dict__:
            part.__dict__["spaces"] = self.spaces.join(spots, on, "left_semi")
        return part


def _distances(context: Context, params: dict[str, Any]) -> DataFrame:
    return distances.distances(context.spaces, KEY, params["d_cont_starts"], params["d_min_max_exhaustive"])


def _weight_stats(context: Context, params: dict[str, Any]) -> DataFrame:
    return incidence.weight_stats(context.entries, context.dims, KEY)


def _entropy_profile(context: Context, params: dict[str, Any]) -> DataFrame:
    return gf2.entropy_profile(context.spaces, KEY, params["start_position"])


def _weight_spectrum(context: Context, params: dict[str, Any]) -> DataFrame:
    return incidence.weight_spectrum(context.entries, context.dims, KEY)


def _logical_weights(context: Context, params: dict[str, Any]) -> DataFrame:
    bounds = context.outputs.get("distances") if params["use_d_cont_bound"] else None
    return distances.logical_weights(context.spaces, KEY, bounds, params["max_exhaustive"])


def _aggregates(context: Context, params: dict[str, Any]) -> DataFrame:
    scalar = ("distances", "weight_stats", "logical_weights")
    nested = {
        name: df.select(*KEY, F.struct(*[c for c in df.columns if c not in KEY]).alias(name))
        for name, df in context.outputs.items()
        if name in scalar
    }
    joined = attach_analyses(context.samples, nested, KEY)
    return cellstats.cell_rollup(
        joined,
        ("run_id", "n", "p"),
        quantiles=params["quantiles"],
        z=params["wilson_z"],
        condition_column=params["conditional_column"],
        condition_text=params["conditional_predicate"],
    )


register_analysis(
    Analysis(
        "distances",
        _distances,
        {"d_cont_starts": distances.START_FRACTIONS, "d_min_max_exhaustive": distances.MAX_EXHAUSTIVE},
    )
)
register_analysis(Analysis("weight_stats", _weight_stats))
register_analysis(Analysis("entropy_profile", _entropy_profile, {"start_position": 0}))
register_analysis(Analysis("weight_spectrum", _weight_spectrum))
register_analysis(
    Analysis(
        "logical_weights",
        _logical_weights,
        {"max_exhaustive": distances.MAX_LOGICAL, "use_d_cont_bound": True},
        expensive=True,
    )
)
register_analysis(
    Analysis(
        "aggregates",
        _aggregates,
        {
            "quantiles": cellstats.QUANTILES,
            "wilson_z": 1.96,
            "conditional_column": "obs.k",
            "conditional_predicate": "> 0",
        },
        per_cell=False,
    )
)
