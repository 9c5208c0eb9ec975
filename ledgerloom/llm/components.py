"""Connected components of an edge table, by smallest labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.staging import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: long); the component is its smallest node.

    Each round takes the smallest label of the neighbours, then the label of that label, and writes the labels; rounds
    grow with the logarithm of a component's width. Only the number of changed labels reaches the driver.
    """
    edges = edges.select("u", "v").where("u <> v").distinct()
    both = stage(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    labels = stage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        to = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = lower.join(to, "component").select("node", "old", F.least("component", "further").alias("component"))
        after = stage(jumped, "labels")
        labels = after.select("node", "component")
        if not after.where("component <> old").limit(1).count():
            return labels
