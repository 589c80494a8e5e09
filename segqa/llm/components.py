"""Connected components by contraction, for graphs of any size and shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segqa.plans.scale import materialize


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)``: each node of an edge and the smallest node of its component.

    Every round each node points to its smallest neighbour, or to itself, and from there once
    more; the ends of the edges are replaced by what they point to, and edges within one node
    go. The smallest node of a component always stays, so it is the last one left. A round
    joins on nodes only and writes its two tables to the shared folder, so lineage does not
    grow and no list of neighbours is ever built. Null ends and loops count as no edge.
    """
    edges = edges.select("a", "b").where("a <> b")
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("to"))
        points = materialize(points)
        further = points.select(F.col("node").alias("to"), F.col("to").alias("further"))
        points = materialize(points.join(further, "to").select("node", F.col("further").alias("to")))
        if roots is None:
            roots = points.withColumnRenamed("to", "root")
        else:
            step = points.withColumnRenamed("node", "root")
            roots = materialize(roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        a = points.select(F.col("node").alias("a"), F.col("to").alias("x"))
        b = points.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(a, "a").join(b, "b").where("x <> y")
        edges = materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots
