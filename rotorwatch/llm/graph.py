"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotorwatch.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of the edges ``(a, b)``; the label is the smallest node that
    can be reached.

    Each round takes the smallest label among neighbours and then the label's own label, so
    paths shorten fast. Joins put one label row against many edge rows, which Spark splits
    where a node has very many; one number a round reaches the driver.
    """
    both = materialize(
        edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), "edges"
    )
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("of_b")), "b")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("of_b").alias("near"))
        moved = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        moved = materialize(moved, "moved")
        jump = moved.select(F.col("node").alias("new"), F.col("new").alias("jump"))
        after = materialize(moved.join(jump, "new").select("node", "label", F.least("new", "jump").alias("new")), "labels")
        changed = after.where("label <> new").isEmpty()
        labels = after.select("node", F.col("new").alias("label"))
        if changed:
            return labels
