"""Connected components by minimum labels and pointer jumping over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsieve.llm.common import discard, staged


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``edges`` (a long, b long).

    A round takes the smallest label among the neighbours (partial minima before the shuffle, so a hub is
    no hot key; its edges may be split by AQE, for labels are unique) and then the label of that label.
    Labels only fall, so the rounds end; they are about the logarithm of the longest chain.
    """
    edges = edges.where("a <> b")
    both = staged(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    written = labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("component").alias("seen"))
        nearest = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        lower = labels.join(nearest, "node").select("node", F.least("component", "seen").alias("next"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("jumped"))
        moved = lower.join(jump, "next").select(
            "node", F.least("next", "jumped").alias("component"), (F.least("next", "jumped") != F.col("old")).alias("moved")
        )
        moved = staged(moved, "labels")
        labels = moved.select("node", "component")
        discard(written)  # its successor is written
        written = moved
        if moved.where("moved").isEmpty():
            discard(both)
            return labels
