"""Triangle counts, locality statistics and transitivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vertexloom.graph import Graph
from vertexloom.operators.degree import degree
from vertexloom.plans.scratch import Scratch

#: Ids that an array holds about, at most; longer rings are cut into parts by a hash of the id.
RING_IDS = 1 << 18


def _oriented(links: DataFrame) -> DataFrame:
    """Each link once, from the end with the smaller (degree, id).

    A vertex then has few outgoing links, at most the root of twice the number
    of all links, so pairs of links at one vertex stay near linear in the input.
    """
    size = links.groupBy("src").agg(F.count("*").alias("n"))
    a = size.select(F.col("src").alias("src"), F.col("n").alias("na"))
    b = size.select(F.col("src").alias("dst"), F.col("n").alias("nb"))
    met = links.where("src < dst").join(a, "src").join(b, "dst")
    first = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("src") < F.col("dst")))
    return met.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("src"),
                      F.when(first, F.col("dst")).otherwise(F.col("src")).alias("dst"))


def triangle_list(graph: Graph) -> DataFrame:
    """``(a, b, c)``: each triangle of the underlying simple undirected graph once."""
    o = _oriented(graph.links)
    ab = o.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    ac = o.select(F.col("src").alias("a"), F.col("dst").alias("c"))
    wedges = ab.join(ac, "a").where("b < c")
    closing = o.select(F.least("src", "dst").alias("b"), F.greatest("src", "dst").alias("c"))
    return wedges.join(closing, ["b", "c"], "left_semi").select("a", "b", "c")


def _per_vertex(graph: Graph, found: DataFrame) -> DataFrame:
    counted = found.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(
        F.count("*").alias("triangles"))
    return graph.vertices.join(counted, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def triangles(graph: Graph, kind: str = "cycle") -> DataFrame:
    """``(id, triangles)`` through every vertex; loops and repeated edges are ignored.

    Undirected graphs count triangles. Directed ones count cycles a→b→c→a
    (``kind="cycle"``) or, with ``"all"``, triangles whatever the directions.
    """
    if kind not in ("cycle", "all"):
        raise ValueError("kind must be 'cycle' or 'all'")
    if not graph.directed or kind == "all":
        return _per_vertex(graph, triangle_list(graph))
    e = graph.edges.where("src <> dst").select("src", "dst").distinct()
    # a cycle's triangle exists in the underlying graph, so candidates come from the oriented list
    t = triangle_list(graph)
    turns = t.select(F.explode(F.array(F.struct("a", "b", "c"), F.struct("a", F.col("c").alias("b"), F.col("b").alias("c")))).alias("t")).select("t.*")
    for x, y in (("a", "b"), ("b", "c"), ("c", "a")):
        turns = turns.join(e.select(F.col("src").alias(x), F.col("dst").alias(y)), [x, y], "left_semi")
    return _per_vertex(graph, turns.select("a", "b", "c"))


def _pairs(graph: Graph) -> DataFrame:
    """``(p, q, n)``: how many edges join each two vertices, directions ignored; loops have ``p = q``."""
    return graph.edges.groupBy(F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q")).agg(
        F.count("*").alias("n"))


def _inside(graph: Graph, pairs: DataFrame) -> DataFrame:
    """``(id, n)`` for the edges inside closed neighbourhoods, loops aside, without listing balls.

    Own edges, and for each triangle the edges opposite to each corner.
    """
    e = pairs.where("p <> q")
    own = e.select(F.explode(F.array("p", "q")).alias("id"), "n")
    t = triangle_list(graph)
    opposite = t.select(F.explode(F.array(
        F.struct(F.col("a").alias("id"), F.least("b", "c").alias("p"), F.greatest("b", "c").alias("q")),
        F.struct(F.col("b").alias("id"), F.least("a", "c").alias("p"), F.greatest("a", "c").alias("q")),
        F.struct(F.col("c").alias("id"), F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")))).alias("t")).select("t.*")
    return own.unionByName(opposite.join(e, ["p", "q"]).select("id", "n"))


def _scan1(graph: Graph) -> DataFrame:
    """Order one: the edges inside, and loops at the vertex or at a neighbour."""
    pairs = _pairs(graph)
    loops = pairs.where("p = q").select(F.col("p").alias("id"), "n")
    beside = loops.withColumnRenamed("id", "dst").join(graph.links, "dst").select(F.col("src").alias("id"), "n")
    return _inside(graph, pairs).unionByName(loops).unionByName(beside).groupBy("id").agg(F.sum("n").alias("scan"))


def _scan2(graph: Graph) -> DataFrame:
    """Order two: edges that touch the closed neighbourhood, and those between two vertices at distance two.

    The first kind are sums of degrees, less the edges inside, which are met
    from both ends. Only the second kind needs the two-step rings, and each of
    its edges is followed from the end with fewer links, so a hub in many rings
    multiplies none of them by its degree. Rings are kept as arrays by the vertex
    at their end, so an edge sends one row and not one for each ring.
    """
    scratch = Scratch(graph.spark, "scan2")
    pairs = scratch.save(_pairs(graph), "pairs")
    links = scratch.save(graph.links, "links")
    steps = links.select(F.col("src").alias("id"), F.col("dst").alias("v"))
    near = steps.unionAll(graph.vertices.select("id", F.col("id").alias("v")))
    ends = F.when(F.col("p") == F.col("q"), F.array("p")).otherwise(F.array("p", "q"))
    at = pairs.select(F.explode(ends).alias("v"), "n").groupBy("v").agg(F.sum("n").alias("n"))
    touching = near.join(at, "v").select("id", "n")
    twice = _inside(graph, pairs).select("id", (-F.col("n")).alias("n"))
    size = links.groupBy("src").agg(F.count("*").alias("n"))
    most = links.join(size.withColumnRenamed("src", "dst"), "dst").groupBy("src").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    part = F.pmod(F.xxhash64("id"), F.lit(-(-most // RING_IDS) or 1)).alias("part")
    # dealt out by v once, for the distinct rows and for their arrays
    ring = steps.join(links.withColumnRenamed("src", "v"), "v").select("id", F.col("dst").alias("v")).where(
        "id <> v").repartition("v").distinct().join(steps, ["id", "v"], "left_anti")
    ring = scratch.save(ring.groupBy("v", part).agg(F.array_sort(F.collect_list("id")).alias("ids")), "ring")
    ways = _oriented(links).withColumn("p", F.least("src", "dst")).withColumn("q", F.greatest("src", "dst")).join(
        pairs, ["p", "q"]).select(F.col("src").alias("v"), F.col("dst").alias("w"), "n")
    between = ring.join(ways, "v").select(F.col("w").alias("v"), "part", "n", F.col("ids").alias("sent")).join(
        ring, ["v", "part"]).select(F.explode(F.array_intersect("sent", "ids")).alias("id"), "n")
    loops = ring.join(pairs.where("p = q").select(F.col("p").alias("v"), "n"), "v").select(F.explode("ids").alias("id"), "n")
    return touching.unionByName(twice).unionByName(between).unionByName(loops).groupBy("id").agg(F.sum("n").alias("scan"))


def local_scan(graph: Graph, order: int = 1) -> DataFrame:
    """``(id, scan)``: edges inside each vertex's closed neighbourhood, directions ignored.

    Order 0 is the degree; orders 1 and 2 count edges among the vertices within
    so many steps. Other orders raise ``ValueError``.
    """
    if order == 0:
        return degree(graph, "both").withColumnRenamed("degree", "scan")
    if order not in (1, 2):
        raise ValueError("order must be 0, 1 or 2")
    found = _scan1(graph) if order == 1 else _scan2(graph)
    return graph.vertices.join(found, "id", "left").select("id", F.coalesce("scan", F.lit(0)).cast("long").alias("scan"))


def topk_scan(graph: Graph, order: int = 1, k: int = 1) -> DataFrame:
    """``(vid, scan)``: the ``k`` vertices with the largest scan, ties to the smaller id; directed graphs only."""
    graph.need_directed("topk_scan")
    if k < 1:
        raise ValueError("k must be at least 1")
    return local_scan(graph, order).orderBy(F.desc("scan"), "id").limit(k).select(F.col("id").alias("vid"), "scan")


def transitivity(graph: Graph, kind: str = "global") -> DataFrame:
    """``(id, transitivity)`` for ``kind="local"``, one row ``(transitivity)`` for ``"global"``.

    Undirected: triangles over pairs of neighbours. Directed: edges among the
    neighbours, ``scan1 - degree``, over ``degree * (degree - 1)`` with in- and
    outgoing edges counted. NaN where a vertex has fewer than two edges, or
    globally where no vertex has two.
    """
    if kind not in ("local", "global"):
        raise ValueError("kind must be 'local' or 'global'")
    d = degree(graph, "both")
    if graph.directed:
        x = local_scan(graph, 1).join(d, "id").select("id", "degree", (F.col("scan") - F.col("degree")).alias("x"))
    else:
        x = triangles(graph).join(d, "id").select("id", "degree", (F.col("triangles") * 2).alias("x"))
    pairs = F.col("degree") * (F.col("degree") - 1)
    nan = F.lit(float("nan"))
    if kind == "local":
        return x.select("id", F.when(F.col("degree") < 2, nan).otherwise(F.col("x") / pairs).alias("transitivity"))
    return x.agg(F.sum("x").alias("x"), F.sum(pairs).alias("p")).select(
        F.when(F.coalesce("p", F.lit(0)) == 0, nan).otherwise(F.col("x") / F.col("p")).alias("transitivity"))
