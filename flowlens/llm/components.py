"""Connected components by contraction: every node points to its least neighbour, pointers are shortened, edges between
merged nodes vanish. Each round leaves at most half of the nodes that still have edges; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowlens.session import files_for, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: columns a, b (long; loops and repeats allowed). A row for each node that has an edge to another: node, component (its least node)."""
    edges = materialize(edges.filter("a != b").select("a", "b").distinct())
    labels = None
    while left_over := edges.count():
        files = files_for(left_over)
        seen = files if labels is None else seen  # a label for each node, of which there are fewer than edges and one
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), files)
        for _ in range(2):
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p").select("a", F.col("pp").alias("p"))
        parent = materialize(parent, files)
        if labels is None:
            labels = parent.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            labels = materialize(labels.join(parent, F.col("component") == F.col("a"), "left").select("node", F.coalesce("p", "component").alias("component")), 2 * seen)
        left = parent.select("a", F.col("p").alias("x"))
        right = parent.select(F.col("a").alias("b"), F.col("p").alias("y"))
        edges = materialize(edges.join(left, "a").join(right, "b").filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), files)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
