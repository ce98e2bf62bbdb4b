"""Connected components by contraction: each round joins every node to its smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (node, component), the component named by its smallest node.

    The graph that is left halves at least with each round; both it and the labels are written to
    the checkpoint folder, so the lineage stays short. Nodes without edges aren't returned; loops and
    repeated edges do no harm.
    """
    pairs = edges.where("a <> b").select("a", "b")
    links = pairs.union(pairs.select("b", "a")).distinct().checkpoint()
    labels = links.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    while not links.isEmpty():
        parent = links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("p"))
        up = parent.select(F.col("a").alias("component"), "p")
        labels = labels.join(up, "component", "left").select("node", F.coalesce("p", "component").alias("component")).checkpoint()
        other = parent.select(F.col("a").alias("b"), F.col("p").alias("q"))
        links = links.join(parent, "a").join(other, "b").where("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct().checkpoint()
    return labels
