"""PageRank in the original unnormalised form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

from vertexloom.graph import Graph
from vertexloom.plans.scratch import Scratch

#: Edges that a block holds on average, at most; larger graphs get more blocks.
BLOCK_EDGES = 1 << 20
BLOCK = ("b long, n long, m long, ids binary, own binary, p binary, t binary, w binary, tos binary, toff binary, "
         "sel binary, froms binary, foff binary, pos binary")
SENT = "b long, sender long, vals binary, moved double"


def _labels(graph: Graph, n: int) -> list[int]:
    """``n`` numbers that a hash partitioning into ``n`` puts into partitions of their own."""
    found = graph.spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("k")).agg(F.min("id").alias("id"))
    got = [r.id for r in found.collect()]
    return got + [64 * n + i for i in range(n - len(got))]


def _blocks(graph: Graph, scratch: Scratch, parts: int) -> tuple[DataFrame, int]:
    """One row per block of vertices, with their outgoing edges as arrays, and the number of blocks.

    A source with more than an even part of all edges stands in several blocks
    under as many salts, so that its edges are spread like everyone else's; each
    of its places gets all sums for it, so all have its rank. A block knows which of
    its sums go to which block, and in whose order it gets theirs, so steps send
    bare numbers.
    """
    merged = scratch.save(graph.edges.groupBy("src", "dst").agg(F.count("*").alias("m")), "merged")
    count = merged.count()
    parts = max(parts, -(-count // BLOCK_EDGES))
    even = max(1, count // parts)
    labels = F.array(*[F.lit(x).cast("long") for x in _labels(graph, parts)])
    out = scratch.save(merged.groupBy("src").agg(F.sum("m").alias("n"), F.least(
        F.ceil(F.count("*") / even), F.lit(parts)).cast("int").alias("salts")), "out")
    places = graph.vertices.select("id").join(out.select(F.col("src").alias("id"), "salts"), "id", "left").select(
        "id", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")).select(
        "id", "salt", labels[F.pmod(F.xxhash64("id") + F.col("salt"), F.lit(parts)).cast("int")].alias("b"))
    places = scratch.save(places.withColumn(
        "pos", F.row_number().over(Window.partitionBy("b").orderBy("id", "salt")) - 1), "places")
    edges = merged.join(out, "src").select(
        F.col("src").alias("id"), F.pmod(F.xxhash64("dst"), "salts").cast("int").alias("salt"), "dst",
        (F.col("m") / F.col("n")).alias("w")).join(places, ["id", "salt"]).select("b", "pos", "dst", "w")
    edges = scratch.save(edges, "edges")
    met = scratch.save(edges.select("b", "dst").distinct().withColumnRenamed("b", "sender").join(
        places.select(F.col("id").alias("dst"), "b", "pos"), "dst"), "met")
    none = F.lit(0.0).alias("w")
    rows = edges.select("b", F.lit(0).alias("role"), "pos", "dst", F.lit(0).cast("long").alias("other"), "w").unionAll(
        met.select(F.col("sender").alias("b"), F.lit(1).alias("role"), "pos", "dst", F.col("b").alias("other"), none)).unionAll(
        met.select("b", F.lit(2).alias("role"), "pos", "dst", F.col("sender").alias("other"), none)).unionAll(
        places.select("b", F.lit(3).alias("role"), "pos", F.col("id").alias("dst"), F.col("salt").cast("long").alias("other"), none))
    names = [f.split()[0] for f in BLOCK.split(", ")]

    # defined here, so that workers need not import this module
    def pack(table: pa.Table) -> pa.Table:
        role, pos, dst, other, w = (table.column(c).to_numpy() for c in ("role", "pos", "dst", "other", "w"))

        def grouped(k: int) -> tuple:
            mine = np.flatnonzero(role == k)
            mine = mine[np.lexsort((pos[mine], dst[mine], other[mine]))]
            ends, at = np.unique(other[mine], return_index=True)
            return mine, ends.astype(np.int64), np.append(at, len(mine)).astype(np.int64)

        edge = np.flatnonzero(role == 0)
        sums, t = np.unique(dst[edge], return_inverse=True)
        send, tos, toff = grouped(1)
        get, froms, foff = grouped(2)
        here = np.flatnonzero(role == 3)
        here = here[np.argsort(pos[here])]
        arrays = [dst[here].astype(np.int64), other[here] == 0, pos[edge].astype(np.int32), t.astype(np.int32),
                  w[edge].astype(np.float64), tos, toff, np.searchsorted(sums, dst[send]).astype(np.int32),
                  froms, foff, pos[get].astype(np.int32)]
        head = [pa.array([x], pa.int64()) for x in (table.column("b")[0].as_py(), len(here), len(sums))]
        return pa.table(head + [pa.array([a.tobytes()], pa.binary()) for a in arrays], names=names)

    packed = scratch.save(rows.groupBy("b").applyInArrow(pack, BLOCK), "blocks")
    return packed.repartition(parts, "b").persist(StorageLevel.MEMORY_AND_DISK), parts


def _stepper(damping: float, last: bool):
    """What a block does with the sums it gets: its ranks, then the sums it sends; or ``(id, rank)`` at the end."""
    kinds = {"ids": np.int64, "own": np.bool_, "p": np.int32, "t": np.int32, "w": np.float64, "tos": np.int64, "toff": np.int64,
             "sel": np.int32, "froms": np.int64, "foff": np.int64, "pos": np.int32}

    def step(block: pa.Table, sent: pa.Table) -> pa.Table:
        def held(c: str):
            return np.frombuffer(block.column(c)[0].as_buffer(), kinds[c])

        b, n, m = (block.column(c)[0].as_py() for c in ("b", "n", "m"))
        senders = sent.column("sender").to_pylist()
        got = {k: np.frombuffer(v.as_buffer(), np.float64) for k, v in zip(senders, sent.column("vals"))}
        old = got.pop(-1, None)
        if last:
            own = held("own")
            return pa.table({"id": held("ids")[own], "rank": old[own]})
        rank, moved = np.full(n, 1.0 - damping), float("inf")
        if old is not None:
            sums, froms, foff, pos = np.zeros(n), held("froms"), held("foff"), held("pos")
            for k, sender in enumerate(froms):
                sums[pos[foff[k]:foff[k + 1]]] += got[sender]
            rank += damping * sums
            moved = float(np.abs(rank - old).max())
        x = np.bincount(held("t"), weights=rank[held("p")] * held("w"), minlength=m)
        tos, toff, sel = held("tos"), held("toff"), held("sel")
        vals = [rank.tobytes(), *(x[sel[toff[k]:toff[k + 1]]].tobytes() for k in range(len(tos)))]
        return pa.table({"b": pa.array([b, *tos.tolist()], pa.int64()), "sender": pa.array([-1] + [b] * len(tos), pa.int64()),
                         "vals": pa.array(vals, pa.binary()), "moved": pa.array([moved] + [None] * len(tos), pa.float64())})

    return step


def pagerank(graph: Graph, max_iters: int = 1000, damping: float = 0.85, tol: float | None = None,
             cut_every: int = 5) -> DataFrame:
    """``(id, rank)`` with ``rank(v) = (1 - d) + d * sum(rank(u) / outdegree(u))``; directed graphs only.

    Starts at ``1 - d`` and stops after ``max_iters`` steps or at the first
    step at which no rank moved by more than ``tol`` (by default a thousandth of
    ``1 - d``; 0 never stops early). Vertices without outgoing edges pass
    nothing on; repeated edges carry their share each. The edges stay where they
    are, as arrays; a step sends each block's sum for a vertex to where the
    vertex is. Without a ``tol`` lineage is cut every ``cut_every`` steps, with
    one after each.
    """
    graph.need_directed("pagerank")
    spark = graph.spark
    scratch = Scratch(spark, "pagerank")
    tol = 1e-3 * (1 - damping) if tol is None else tol
    burst = 1 if tol > 0 else cut_every
    blocks, _ = _blocks(graph, scratch, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def after(sent: DataFrame, schema: str = SENT) -> DataFrame:
        return blocks.groupBy("b").cogroup(sent.groupBy("b")).applyInArrow(_stepper(damping, schema != SENT), schema)

    sent = saved = scratch.save(after(spark.createDataFrame([], SENT)), "sent")
    steps = 0
    while steps < max_iters:
        for _ in range(min(burst, max_iters - steps)):
            sent = after(sent)
            steps += 1
        sent = scratch.save(sent, "sent")
        still = tol > 0 and not sent.where(F.col("moved") > tol).limit(1).count()
        scratch.drop(saved)
        saved = sent
        if still:
            break
    ranks = scratch.save(after(saved, "id long, rank double"), "ranks")
    scratch.drop(saved)
    blocks.unpersist()
    return ranks
