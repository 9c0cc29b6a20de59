"""Core numbers by H-indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vertexloom.graph import Graph
from vertexloom.plans.scratch import Scratch


#: Steps between two cuts of the lineage; a step past the last change alters nothing.
BURST = 2


def kcore(graph: Graph, k_start: int = 2, k_end: int = 10) -> DataFrame:
    """``(id, core)``: the core number of every vertex by in- plus outgoing edges, repeats counted.

    Vertices below ``k_start`` get ``k_start - 1``; those above ``k_end`` get -1,
    ``k_end=0`` sets no end. Every vertex starts at its degree and takes the
    H-index of its neighbours' values, the largest h such that h edges lead to
    values of h or more, until nothing changes; the values then are the core
    numbers (Lü et al. 2016). A vertex counts its edges by value first, so a hub
    is summed within each task.
    """
    if k_start < 1 or (k_end and k_end < k_start):
        raise ValueError("need 1 <= k_start <= k_end, or k_end = 0")
    scratch = Scratch(graph.spark, "kcore")
    links = scratch.save(graph.sym.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n")), "links")
    top = F.lit(k_end + 1 if k_end else (1 << 62))
    values = scratch.save(links.groupBy("src").agg(F.least(F.sum("n"), top).alias("c")), "values")
    seen = None
    while True:
        nxt = values
        for _ in range(BURST):
            met = links.join(nxt.select(F.col("src").alias("dst"), "c"), "dst").groupBy("src", "c").agg(F.sum("n").alias("n"))
            so_far = F.sum("n").over(Window.partitionBy("src").orderBy(F.desc("c")))
            nxt = met.select("src", F.least("c", so_far).alias("h")).groupBy("src").agg(F.max("h").alias("c"))
        nxt = scratch.save(nxt, "values")
        scratch.drop(values)
        values, total = nxt, nxt.agg(F.sum("c")).first()[0]
        if total == seen:
            break
        seen = total
    core = F.coalesce("c", F.lit(0))
    return graph.vertices.join(values.withColumnRenamed("src", "id"), "id", "left").select("id", F.when(
        core < k_start, k_start - 1).when(F.lit(bool(k_end)) & (core > k_end), -1).otherwise(core).cast("long").alias("core"))
