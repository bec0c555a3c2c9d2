"""Connected components over link tables, by minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of links; root is the least node of its component.

    Each round takes the least root among a node's neighbours and then the root's own root, so the
    rounds grow with the logarithm of the longest chain. Every round is written to the shared folder.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = materialize(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).filter("x != y").distinct())
    labels = materialize(edges.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("root")).withColumnRenamed("x", "node"))
    while True:
        near = edges.join(labels, edges.y == labels.node).groupBy("x").agg(F.min("root").alias("near"))
        step = labels.join(near, labels.node == near.x).select("node", F.least("root", "near").alias("new"), "root")
        up = step.select(F.col("node").alias("up_node"), F.col("new").alias("up"))
        after = materialize(step.join(up, step.new == up.up_node, "left").select("node", F.least("new", F.coalesce("up", "new")).alias("new"), "root"))
        labels = after.select("node", F.col("new").alias("root"))
        if after.filter("new != root").isEmpty():
            return labels
