"""Streaming detection of the first zero of each sample's time series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "n int, p double, sample_seed bigint, tau bigint, censored boolean"
KEYS = ("run_id", "n", "p", "sample_seed")  # seeds repeat across runs; a stream of one run may lack run_id
STATE = "done boolean"


def first_zeros(trace: DataFrame, cap: int, ttl_ms: int | None = None) -> DataFrame:
    """Emit each sample once: at its first row with s = 0, or as censored at t = ``cap``.

    Rows of one sample arrive in time order.  The state is one flag per sample.  In a
    continuous query set ``ttl_ms`` to drop it that long after the sample's last row; a
    query that stops by itself (``availableNow``) must not set it, since processing-time
    timeouts keep asking for another batch.
    """
    keys = [k for k in KEYS if k in trace.columns]
    output = OUTPUT if len(keys) < len(KEYS) else f"run_id {trace.schema['run_id'].dataType.simpleString()}, {OUTPUT}"
    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done = bool(state.get[0]) if state.exists else False
        zero, end = None, False
        for batch in batches:  # only the smallest zero is kept, not the rows
            zeros = batch.loc[batch["s"] == 0, "t"]
            if len(zeros):
                zero = int(zeros.min()) if zero is None else min(zero, int(zeros.min()))
            end = end or bool((batch["t"] >= cap).any())
        if not done and (zero is not None or end):
            done = True
            tau = pd.array([zero], dtype="Int64")
            yield pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "tau": tau, "censored": [zero is None]})
        state.update((done,))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)

    return trace.groupBy(*keys).applyInPandasWithState(
        watch, output, STATE, "append", timeout
    )


def first_zero_table(trace: DataFrame, cap: int) -> DataFrame:
    """The same decision as a running aggregate, for sinks that keep the latest row of a sample (update mode).

    Rows that decide nothing are dropped before the shuffle and the state is one number per decided sample, kept by
    Spark's own aggregation: no function runs per sample.  Rows behind ``cap`` only tell that it was reached, in whatever
    batch they come.
    """
    keys = [k for k in KEYS if k in trace.columns]
    zero = (F.col("s") == 0) & (F.col("t") <= cap)
    found = trace.where(zero | (F.col("t") >= cap)).groupBy(*keys).agg(F.min(F.when(zero, F.col("t"))).alias("tau"))
    return found.select(*keys, "tau", F.col("tau").isNull().alias("censored"))
