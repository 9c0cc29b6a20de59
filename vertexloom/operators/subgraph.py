"""Induced subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vertexloom.graph import Graph
from vertexloom.plans.scratch import Scratch


def renumber(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, new_id)``: ranks from zero by id.

    Ids are range-partitioned and counted by partition, so no single task
    numbers them all.
    """
    parts = scratch.save(ids.select("id").distinct().repartitionByRange("id").select(
        "id", F.spark_partition_id().alias("part")), "ranges")
    before = parts.groupBy("part").count().select("part", (F.sum("count").over(
        Window.orderBy("part")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    return parts.withColumn("place", place).join(F.broadcast(before), "part").select(
        "id", (F.col("before") + F.col("place")).cast("long").alias("new_id"))


def induced(graph: Graph, vertices: DataFrame | list[int], name: str | None = None, compress: bool = True) -> Graph:
    """The subgraph of the given vertices and all edges between them.

    ``compress`` renumbers ids densely from zero in their old order; the
    mapping is the result's ``mapping (id, new_id)``. Selected vertices without
    an edge are kept. Unknown ids raise ``ValueError``.
    """
    spark = graph.spark
    if not isinstance(vertices, DataFrame):
        vertices = spark.createDataFrame([(int(v),) for v in vertices], "id long")
    ids = vertices.select(F.col("id").cast("long").alias("id")).distinct()
    unknown = ids.join(graph.vertices, "id", "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"not a vertex: {unknown[0].id}")
    edges = graph.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(
        ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(*graph.edges.columns)
    out = Graph(ids, edges, graph.directed, name or f"{graph.name}-sub")
    if compress:
        mapping = renumber(ids, Scratch(spark, "subgraph"))
        rest = [c for c in edges.columns if c not in ("src", "dst")]
        a = mapping.select(F.col("id").alias("src"), F.col("new_id").alias("a"))
        b = mapping.select(F.col("id").alias("dst"), F.col("new_id").alias("b"))
        moved = edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), *rest)
        out = Graph(mapping.select(F.col("new_id").alias("id")), moved, graph.directed, out.name)
        out.mapping = mapping
    return out
