"""Neighbourhood overlap, breadth-first distances, diameter and betweenness."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from vertexloom.graph import Graph
from vertexloom.operators.components import min_label
from vertexloom.plans.scratch import Scratch

#: Ids given as a Python list are broadcast; the list is a parameter and stays under this many.
MAX_LISTED = 100_000


def _listed(graph: Graph, vids: Iterable[int] | DataFrame) -> DataFrame:
    if isinstance(vids, DataFrame):
        return vids.select(F.col("id").cast("long").alias("id")).distinct()
    rows = sorted({int(v) for v in vids})
    if len(rows) > MAX_LISTED:
        raise ValueError(f"give more than {MAX_LISTED} ids as a DataFrame")
    return graph.spark.createDataFrame([(v,) for v in rows], "id long")


def overlap(graph: Graph, vids: Iterable[int] | DataFrame) -> DataFrame:
    """``(vid_i, vid_j, common, overlap)``: Jaccard overlap of the neighbours of each pair of given vertices.

    Directions are ignored. Pairs with no common neighbour are left out, as in
    a sparse matrix; a vertex with any neighbour overlaps itself with 1.
    Directed graphs only.
    """
    graph.need_directed("overlap")
    ids = _listed(graph, vids)
    near = graph.links.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    d = near.groupBy("src").agg(F.count("*").alias("d"))
    a = near.select(F.col("src").alias("vid_i"), "dst")
    b = near.select(F.col("src").alias("vid_j"), "dst")
    # each pair is counted once and shown both ways
    half = a.join(b, "dst").where("vid_i <= vid_j").groupBy("vid_i", "vid_j").agg(F.count("*").alias("common"))
    same = F.array(F.struct("vid_i", "vid_j"))
    ways = F.array(F.struct("vid_i", "vid_j"), F.struct(F.col("vid_j").alias("vid_i"), F.col("vid_i").alias("vid_j")))
    common = half.select("common", F.explode(F.when(F.col("vid_i") == F.col("vid_j"), same).otherwise(ways)).alias("p")).select(
        "p.*", "common")
    return common.join(d.select(F.col("src").alias("vid_i"), F.col("d").alias("di")), "vid_i").join(
        d.select(F.col("src").alias("vid_j"), F.col("d").alias("dj")), "vid_j").select(
        "vid_i", "vid_j", "common",
        (F.col("common") / (F.col("di") + F.col("dj") - F.col("common"))).alias("overlap"))


def distances(graph: Graph, start: DataFrame, scratch: Scratch, follow: bool = False,
              reverse: bool = False) -> DataFrame:
    """``(id, dist)``: steps from the nearest of ``start (id)``; unreached vertices are left out."""
    if follow and graph.directed:
        steps = graph.edges.where("src <> dst").select("src", "dst").distinct()
        if reverse:
            steps = steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    else:
        steps = graph.links
    # an undirected step leads back at most one level, so the last two tell what is new
    back = None if follow and graph.directed else 2
    steps = scratch.save(steps, "steps")
    levels = [scratch.save(start.select("id", F.lit(0).cast("long").alias("dist")).distinct(), "level")]
    while True:
        edge = levels[-1].select(F.col("id").alias("src"))
        known = scratch.union(levels[-back:] if back else levels).select("id")
        new = steps.join(edge, "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(known, "id", "left_anti")
        new = scratch.save(new.select("id", F.lit(len(levels)).cast("long").alias("dist")), "level")
        if not new.limit(1).count():
            return scratch.union(levels)
        levels.append(new)


def diameter(graph: Graph, directed: bool = False) -> DataFrame:
    """One row ``(diameter)``: a lower bound by one double sweep.

    The first sweep starts at the vertex of largest degree (smallest id on a
    tie), the second at the farthest vertex found; the larger of both depths
    counts. ``directed`` follows edges; an undirected graph ignores it.
    """
    from vertexloom.operators.degree import degree

    scratch = Scratch(graph.spark, "diameter")
    root = degree(graph).orderBy(F.desc("degree"), "id").limit(1).select("id")
    root = scratch.save(root, "root")
    first = distances(graph, root, scratch, directed)
    far = first.orderBy(F.desc("dist"), "id").limit(1)
    far = scratch.save(far, "far")
    second = distances(graph, far.select("id"), scratch, directed, reverse=directed)
    return first.unionByName(second).agg(F.coalesce(F.max("dist"), F.lit(0)).cast("long").alias("diameter"))


def betweenness(graph: Graph, vids: Iterable[int] | DataFrame | None = None, batch: int = 256) -> DataFrame:
    """``(id, betweenness)``: shortest paths through each vertex from the sources ``vids`` (all by default).

    Brandes' accumulation over the levels of many sources at once; sources are
    dealt into batches by a hash, which bounds the state of each at about
    ``batch`` x vertices. A source holds no more than its component, so all the
    sources of a graph in many small components share a few batches, and those
    in components of two vertices or fewer, which have nothing between, none.
    Unnormalised; undirected graphs count each pair once.
    """
    scratch = Scratch(graph.spark, "betweenness")
    if graph.directed:
        steps = graph.edges.where("src <> dst").select("src", "dst").distinct()
    else:
        steps = graph.links
    steps = scratch.save(steps.select(F.col("src").alias("v"), F.col("dst").alias("w")), "steps")
    sources = scratch.save((graph.vertices if vids is None else _listed(graph, vids)).select("id"), "sources")
    rounds = 1
    if sources.count() > batch:
        found = scratch.save(min_label(steps.select(F.col("v").alias("u"), F.col("w").alias("v")), scratch), "components")
        size = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 2")
        sources = scratch.save(sources.join(found.join(size, "component").select("id", "n"), "id"), "held")
        state = sources.agg(F.sum("n")).first()[0] or 0
        rounds = -(-state // (batch * graph.vcount))
        sources = sources.select("id")
    sums = []
    for part in range(rounds):
        mine = sources.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == part)
        got = _dependencies(mine, steps, graph.directed, scratch)
        if got is not None:
            sums.append(got)
    half = F.lit(1.0 if graph.directed else 0.5)
    if not sums:
        return graph.vertices.select("id", F.lit(0.0).alias("betweenness"))
    summed = scratch.union(sums).groupBy("id").agg((F.sum("delta") * half).alias("b"))
    return graph.vertices.join(summed, "id", "left").select("id", F.coalesce("b", F.lit(0.0)).alias("betweenness"))


def _dependencies(sources: DataFrame, steps: DataFrame, directed: bool, scratch: Scratch) -> DataFrame | None:
    """``(id, delta)``: summed dependencies of one batch of sources."""
    levels = [scratch.save(sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("sigma")), "l0")]
    while True:
        # an undirected step leads back at most one level; directed ones may go further back
        known = scratch.union(levels if directed else levels[-2:]).select("s", "v")
        moved = levels[-1].join(steps, "v").groupBy("s", F.col("w").alias("v")).agg(F.sum("sigma").alias("sigma"))
        new = scratch.save(moved.join(known, ["s", "v"], "left_anti"), "level")
        if not new.limit(1).count():
            break
        levels.append(new)
    if len(levels) < 3:
        return None
    delta, parts = None, []
    for k in range(len(levels) - 1, 0, -1):
        below = levels[k].select("s", F.col("v").alias("w"), F.col("sigma").alias("sw"))
        below = below.withColumn("dw", F.lit(0.0)) if delta is None else below.join(
            delta.select("s", F.col("v").alias("w"), F.col("delta").alias("dw")), ["s", "w"], "left").fillna(0.0, ["dw"])
        up = levels[k - 1].join(steps, "v").join(below, ["s", "w"]).groupBy("s", "v").agg(
            F.sum(F.col("sigma") / F.col("sw") * (1 + F.col("dw"))).alias("delta"))
        delta = scratch.save(up, "delta")
        if k > 1:
            parts.append(delta)
    out = scratch.save(scratch.union(parts).groupBy(F.col("v").alias("id")).agg(F.sum("delta").alias("delta")), "sums")
    for x in (*levels, *parts, delta):
        scratch.drop(x)
    return out
