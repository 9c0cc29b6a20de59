"""k-means by Lloyd's iterations over vectors or adjacency rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vertexloom.graph import Graph
from vertexloom.plans.scratch import Scratch


@dataclass
class Clustering:
    """``cluster (id, cluster)`` from 1, ``sizes (cluster, size)``, ``centers`` and the rounds done.

    Centres are ``(cluster, center)`` for vectors, and ``(cluster, id, value)``
    with the zeros left out for adjacency rows.
    """

    cluster: DataFrame
    sizes: DataFrame
    centers: DataFrame
    iters: int


def kmeans(rows: DataFrame, k: int, init: list[list[float]] | None = None, max_iters: int = 10,
           tol: float = 1e-6) -> Clustering:
    """Cluster ``rows (id, features array<double>)``, all of one length.

    Starts from ``init`` or from the rows with the ``k`` smallest ids, and stops
    after ``max_iters`` rounds or when no centre moved by more than ``tol``. An
    empty cluster keeps its centre. The ``k`` x dimensions centres are
    broadcast; every task adds its vectors up and hands on ``k`` sums.
    """
    if k < 1 or max_iters < 0:
        raise ValueError("need k >= 1 and max_iters >= 0")
    spark = rows.sparkSession
    scratch = Scratch(spark, "kmeans")
    data = scratch.save(rows.select("id", F.transform("features", lambda x: x.cast("double")).alias("features")), "rows")
    centers = np.array(init or [r.features for r in data.orderBy("id").limit(k).collect()], float)
    done = 0

    # defined here, so that workers need not import this module
    def nearest(lists: pa.ListArray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors of a batch, and for each the index of the nearest centre, ties to the smaller."""
        x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
        return x, np.stack([((x - c) ** 2).sum(1) for c in centers], 1).argmin(1)

    for done in range(1, max_iters + 1 if len(centers) else 1):
        shared = spark.sparkContext.broadcast(centers)

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c = shared.value
            n, total = np.zeros(len(c), np.int64), np.zeros_like(c)
            for batch in batches:
                if batch.num_rows:
                    x, at = nearest(batch.column(0), c)
                    n += np.bincount(at, minlength=len(c))
                    for j in np.unique(at):
                        total[j] += x[at == j].sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(c)), pa.int32()), pa.array(n), pa.array(list(total), pa.list_(pa.float64()))],
                                             names=["c", "n", "total"])

        size, total = np.zeros(len(centers)), np.zeros_like(centers)
        for r in data.select("features").mapInArrow(add, "c int, n long, total array<double>").toLocalIterator():
            size[r.c] += r.n
            total[r.c] += r.total
        fresh = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centers)
        moved = np.sqrt(((fresh - centers) ** 2).sum(1)).max(initial=0.0)
        centers = fresh
        if moved <= tol:
            break
    last = spark.sparkContext.broadcast(centers)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = nearest(batch.column(1), last.value)[1]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at + 1, pa.int32())], names=["id", "cluster"])

    labels = data.mapInArrow(label, f"id {data.schema['id'].dataType.simpleString()}, cluster int")
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("size"))
    table = spark.createDataFrame([(i + 1, c.tolist()) for i, c in enumerate(centers)], "cluster int, center array<double>")
    return Clustering(labels, sizes, table, done)


def _assign(matrix: DataFrame, ids: DataFrame, centers: DataFrame, k: int) -> DataFrame:
    """``(id, cluster)``: the nearest sparse centre of each vertex's row, ties to the smaller.

    Squared distances lack the row's own norm, which is the same for every
    centre, and count to nine digits, so that the order of sums does not show.
    """
    norm = {r.cluster: r.n for r in centers.groupBy("cluster").agg(F.sum(F.col("m") ** 2).alias("n")).collect()}
    dots = matrix.join(centers, "j").groupBy("i", "cluster").agg(F.sum(F.col("v") * F.col("m")).alias("dot"))
    dots = dots.groupBy(F.col("i").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("cluster", "dot"))).alias("dots"))
    known = F.coalesce("dots", F.create_map().cast("map<int,double>"))
    near = F.array_min(F.transform(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(norm.get(c, 0.0)).alias("n")) for c in range(1, k + 1)]), lambda x: F.struct(
        F.round(x["n"] - 2 * F.coalesce(F.element_at(known, x["c"]), F.lit(0.0)), 9).alias("d"), x["c"].alias("c"))))
    return ids.join(dots, "id", "left").select("id", near["c"].alias("cluster"))


def kmeans_graph(graph: Graph, k: int, max_iters: int = 10, tol: float = 1e-4) -> Clustering:
    """Cluster the rows of the adjacency matrix by Lloyd's iterations, rows and centres sparse throughout.

    Starts from the rows of the ``k`` smallest ids, and stops after
    ``max_iters`` rounds or when no centre moved by more than ``tol``. An empty
    cluster keeps its centre. Rows meet centres by their common columns, so
    neither ever becomes dense, and only ``k`` norms come to the driver.
    """
    from vertexloom.functions.linalg import sparse_matrix

    if k < 1 or max_iters < 0:
        raise ValueError("need k >= 1 and max_iters >= 0")
    spark = graph.spark
    scratch = Scratch(spark, "kmeans-graph")
    matrix = scratch.save(sparse_matrix(graph), "matrix")
    ids = scratch.save(graph.vertices.select("id"), "ids")
    first = [r.id for r in ids.orderBy("id").limit(k).collect()]
    k = len(first)
    begun = spark.createDataFrame(list(enumerate(first, 1)), "cluster int, i long")
    centers = scratch.save(matrix.join(F.broadcast(begun), "i").select("cluster", "j", F.col("v").alias("m")), "centers")
    done = 0
    for done in range(1, max_iters + 1 if k else 1):
        at = scratch.save(_assign(matrix, ids, centers, k), "labels")
        size = at.groupBy("cluster").agg(F.count("*").alias("n"))
        means = matrix.join(at.select(F.col("id").alias("i"), "cluster"), "i").groupBy("cluster", "j").agg(
            F.sum("v").alias("s")).join(F.broadcast(size), "cluster").select("cluster", "j", (F.col("s") / F.col("n")).alias("m"))
        fresh = scratch.save(means.unionByName(centers.join(F.broadcast(size), "cluster", "left_anti")), "centers")
        gap = fresh.unionByName(centers.select("cluster", "j", (-F.col("m")).alias("m"))).groupBy("cluster", "j").agg(
            F.sum("m").alias("m")).groupBy("cluster").agg(F.sqrt(F.sum(F.col("m") ** 2)).alias("d")).agg(F.max("d")).first()[0]
        scratch.drop(centers)
        scratch.drop(at)
        centers = fresh
        if (gap or 0.0) <= tol:
            break
    labels = _assign(matrix, ids, centers, k)
    return Clustering(labels, labels.groupBy("cluster").agg(F.count("*").alias("size")),
                      centers.select("cluster", F.col("j").alias("id"), F.col("m").alias("value")), done)
