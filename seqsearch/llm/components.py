"""Connected components of a graph of edges, by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """``u, v`` (any orderable type, no nulls) to ``node, label``: the smallest node that each node reaches.

    Every node of an edge gets a row; self-edges and repeated edges do no harm. Each round links all larger
    neighbours of a node to its smallest one, then all smaller ones; it ends when only stars around their smallest
    node are left. A node with very many edges is an aggregate with partial results and a join that Spark can
    split, not a group in one task. Each round is written to the shared folder.
    """
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v"))
    small = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = small.union(small.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        made = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        small = cut(made, "edges")
        stars = small.join(small.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() and small.groupBy("u").count().where("count > 1").isEmpty()
        if stars:
            break
    label = small.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.distinct().join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
