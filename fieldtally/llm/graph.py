"""Connected components of an edge table by smallest labels with pointer jumping; labels never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.tables import stored


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, root for every node of ``edges`` (a, b); the root is the smallest node of the component.

    A round takes the smallest label among a node and its neighbours, then the label of that label. Chains shrink to a
    fraction in each round, so rounds grow with the logarithm of the longest path. A null end is not an edge.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    both = stored(both, f"{label}-edges")
    both = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), f"{label}-0")
    while True:
        known = labels.select(F.col("node").alias("b"), F.col("root").alias("_near"))
        near = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("_near").alias("_near"))
        lower = labels.join(near, "node", "left").select("node", F.col("root").alias("_old"), F.least("root", "_near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        after = stored(lower.join(jump, "root", "left").select("node", "_old", F.least("root", "_next").alias("root")), label)
        moved = after.where("root <> _old").limit(1).count()
        labels = after.select("node", "root")
        if not moved:
            return labels
