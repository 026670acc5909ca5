"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query runs to completion through the no-op sink, so all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import time

from rategrid.catalog import CATALOG
from rategrid.session import local_session

HEADLINE = (
    "curve_auto_binary",
    "curve_joined_analysis",
    "curve_bootstrap",
    "cell_rollup_by_run",
    "cell_rollup_exact",
    "cell_quantiles_exact",
    "timing_rollup",
    "scaling_exponents",
    "survival_padded",
    "tau_table_events",
    "critical_rate_by_run",
    "weight_stats",
    "hyperedges",
    "bandwidth",
    "packed_rows",
    "gf2_rank_matrices",
    "entropy_profile",
    "contiguous_distance",
    "distances_signs",
    "distances_matrices",
    "logical_weights_bounded",
    "gates_default_draws",
    "schedule_diagnostics",
    "work_plan",
    "stream_running_cells",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "rategrid-bench")
    spark.sparkContext.setLogLevel("OFF")
    names = os.environ.get("BENCH_QUERIES")
    chosen = names.split(",") if names else HEADLINE
    # start the JVM code paths and the Python workers before timing
    CATALOG["curve_sem_alias"](spark, folder).write.format("noop").mode("overwrite").save()
    CATALOG["gf2_rank_signs"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in chosen:
        start = time.perf_counter()
        CATALOG[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    line = {"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds}
    print(json.dumps({**line, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
