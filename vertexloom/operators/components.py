"""Connected components: weak (undirected) and strong.

``min_label`` alternates the large-star and small-star steps of Kiveris et al.
(2014). A step is one partial-aggregated minimum and one join on the vertex, so
a hub with a third of all edges is combined before the shuffle and its join can
be split by adaptive execution. Each step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vertexloom.graph import Graph
from vertexloom.plans.scratch import Scratch

#: What isolated vertices carry: the all-ones 32-bit id.
SENTINEL = 4294967295


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges ``(u, v)`` with ``u > v``."""
    if large:
        out = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        out = edges
    low = out.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("mu"), F.least("m", "u").alias("m"))
    met = out.join(low, F.col("u") == F.col("mu"))
    if large:
        moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select(F.col("mu").alias("u"), F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def min_label(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every endpoint of ``edges (u, v)``.

    ``component`` is the smallest id that can be reached. Loops are ignored;
    an empty input gives an empty result.
    """
    ids = scratch.save(edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    current = ids
    for _ in range(max_rounds):
        nxt = scratch.save(_star(_star(current, True), False), "star")
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(current)
        current = nxt
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def clusters(graph: Graph, mode: str = "weak", isolates: str = "sentinel") -> DataFrame:
    """``(id, component)``: each vertex with the smallest id of its component.

    ``mode`` is ``"weak"`` or ``"strong"``; undirected graphs ignore it. A vertex
    without any edge gets ``SENTINEL``, or its own id with ``isolates="own"``;
    in strong mode a vertex alone in its component always gets its own id.
    """
    if mode not in ("weak", "strong"):
        raise ValueError("mode must be 'weak' or 'strong'")
    if isolates not in ("sentinel", "own"):
        raise ValueError("isolates must be 'sentinel' or 'own'")
    if graph.directed and mode == "strong":
        from vertexloom.operators.strong import strong_components

        return strong_components(graph)
    scratch = Scratch(graph.spark, "wcc")
    found = min_label(graph.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), scratch)
    # a vertex whose only edges are loops has an edge, so it is no isolate
    looped = graph.edges.where("src = dst").select(F.col("src").alias("id")).distinct().join(
        found, "id", "left_anti").select("id", F.col("id").alias("component"))
    alone = F.lit(SENTINEL) if isolates == "sentinel" else F.col("id")
    return graph.vertices.join(found.unionByName(looped), "id", "left").select(
        "id", F.coalesce("component", alone).cast("long").alias("component"))


def largest_component(graph: Graph, mode: str = "weak", name: str | None = None) -> Graph:
    """The largest component as a compressed induced subgraph; ties go to the smaller label.

    Isolates are counted one by one, so they never form a component together.
    """
    from vertexloom.operators.subgraph import induced

    scratch = Scratch(graph.spark, "lcc")
    labels = scratch.save(clusters(graph, mode, isolates="own"), "labels")
    top = labels.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    keep = labels.join(top, "component", "left_semi").select("id")
    return induced(graph, keep, name=name or f"{graph.name}-lcc", compress=True)
