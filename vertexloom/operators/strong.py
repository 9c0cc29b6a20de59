"""Strongly connected components by trimming and colouring."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vertexloom.graph import Graph
from vertexloom.plans.scratch import Scratch


def _spread(start: DataFrame, edges: DataFrame, scratch: Scratch, max_rounds: int) -> DataFrame:
    """``(id, colour)``: the smallest colour that reaches each vertex along ``edges (src, dst)``.

    ``start (id, colour, fresh)`` marks whose colour is to be passed on; in each
    round only vertices whose colour has just changed send it, so late rounds,
    with few of them, neither sort nor shuffle the edges.
    """
    colours = scratch.save(start, "colours")
    for _ in range(max_rounds):
        came = colours.where("fresh").select(F.col("id").alias("src"), "colour").join(edges, "src").groupBy(
            F.col("dst").alias("id")).agg(F.min("colour").alias("c"))
        nxt = scratch.save(colours.join(came, "id", "left").select(
            "id", F.least("colour", F.coalesce("c", "colour")).alias("colour"),
            F.coalesce(F.col("c") < F.col("colour"), F.lit(False)).alias("fresh")), "colours")
        scratch.drop(colours)
        colours = nxt
        if not colours.where("fresh").limit(1).count():
            return colours
    raise RuntimeError("colours did not settle; raise max_rounds")


def strong_components(graph: Graph, max_rounds: int = 10_000) -> DataFrame:
    """``(id, component)``: the smallest id of each vertex's strongly connected component.

    Vertices without incoming or outgoing edges in what is left are components
    of their own and trimmed; then every vertex takes the smallest id that
    reaches it, and those of one colour that reach the colour's own vertex
    backwards form its component. The rest goes into the next round.
    """
    scratch = Scratch(graph.spark, "scc")
    alive = scratch.save(graph.vertices.select("id"), "alive")
    edges = scratch.save(graph.edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    done = []
    for _ in range(max_rounds):
        while True:  # trim
            keep = scratch.save(edges.select(F.col("src").alias("id")).intersect(edges.select(F.col("dst").alias("id"))), "core")
            gone = scratch.save(alive.join(keep, "id", "left_anti").select("id", F.col("id").alias("component")), "trimmed")
            if not gone.limit(1).count():
                scratch.drop(gone)
                scratch.drop(keep)
                break
            done.append(gone)
            left = scratch.save(edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(
                keep.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"), "edges")
            scratch.drop(edges)
            scratch.drop(alive)
            edges, alive = left, keep
        if not alive.limit(1).count():
            break
        colour = _spread(alive.select("id", F.col("id").alias("colour"), F.lit(True).alias("fresh")), edges, scratch, max_rounds)
        a = colour.select(F.col("id").alias("src"), F.col("colour").alias("ca"))
        b = colour.select(F.col("id").alias("dst"), F.col("colour").alias("cb"))
        inside = scratch.save(edges.join(a, "src").join(b, "dst").where("ca = cb").select(
            F.col("dst").alias("src"), F.col("src").alias("dst")), "inside")
        # backwards from each colour's own vertex; the mark 0 spreads, 1 stays
        own = F.col("id") == F.col("colour")
        marks = colour.select("id", F.when(own, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("colour"), own.alias("fresh"))
        back = _spread(marks, inside, scratch, max_rounds)
        found = scratch.save(back.where("colour = 0").select("id").join(colour.select("id", "colour"), "id").select(
            "id", F.col("colour").alias("component")), "found")
        done.append(found)
        rest = scratch.save(alive.join(found, "id", "left_anti"), "alive")
        left = scratch.save(edges.join(rest.withColumnRenamed("id", "src"), "src", "left_semi").join(
            rest.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"), "edges")
        for x in (alive, edges, colour, inside, back):
            scratch.drop(x)
        alive, edges = rest, left
    if not done:
        return graph.spark.createDataFrame([], "id long, component long")
    return scratch.union(done)
