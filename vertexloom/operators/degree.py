"""Degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vertexloom.graph import Graph


def degree(graph: Graph, mode: str = "both") -> DataFrame:
    """``(id, degree)`` of every vertex; repeated edges count, a loop counts at both of its ends.

    ``mode`` is ``both``, ``in`` or ``out``; undirected graphs ignore it.
    """
    if mode not in ("both", "in", "out"):
        raise ValueError("mode must be 'both', 'in' or 'out'")
    if not graph.directed or mode == "both":
        ends = F.explode(F.array("src", "dst"))
    else:
        ends = F.col("src" if mode == "out" else "dst")
    counted = graph.edges.select(ends.alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return graph.vertices.join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
