"""Connected components by label spreading and pointer jumping, in joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rategrid.llm.storage import stage


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` of every node in ``links`` (``a, b``); ``comp`` is the smallest node reachable.

    Each round takes the least label among a node and its neighbours, then the label of that label, so long chains
    shorten by half.  Neighbour labels are pre-aggregated before the shuffle: a hub of any size is no hot key there.
    """
    one = links.filter("a <> b").select("a", "b")
    edges = stage(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage(
        edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("comp")),
        "labels",
    )
    while True:
        seen = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b")
        near = seen.groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("jump"))
        moved = lower.join(jump, "next", "left").select(
            "node", F.coalesce(F.least("next", "jump"), "next").alias("comp"), F.col("comp").alias("was")
        )
        moved = stage(moved, "labels")
        labels = moved.select("node", "comp")
        if not moved.agg(F.max((F.col("comp") != F.col("was")).cast("int"))).first()[0]:
            return labels
