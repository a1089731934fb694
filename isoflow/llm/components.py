"""Connected components by minimum labels and pointer jumping, as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoflow.llm.common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``edges (a, b)``; a component is named by its smallest node.

    Each round takes the smallest label among neighbours and then the label of that label, so the
    number of rounds grows with the logarithm of the diameter.  Nodes without edges do not appear.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        offered = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("offer")), "b").groupBy(F.col("a").alias("node")).agg(F.min("offer").alias("offer"))
        lower = labels.join(offered, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "offer").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        after = materialize(lower.join(jump, "low", "left").select("node", "old", F.least("low", "further").alias("label")), "labels")
        changed = after.where("label <> old").limit(1).count()
        discard(labels)
        labels = after.select("node", "label")
        if not changed:
            discard(both)
            return labels.select("node", F.col("label").alias("component"))
