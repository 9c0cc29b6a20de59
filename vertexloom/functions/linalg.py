"""Sparse matrix-vector products and spectral embedding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from vertexloom.graph import Graph
from vertexloom.plans.scratch import Scratch


def sparse_matrix(graph: Graph) -> DataFrame:
    """``(i, j, v)``: the adjacency matrix; undirected graphs have both halves, weights count where present."""
    e = graph.edges if graph.directed else graph.sym.where("src <> dst").unionByName(graph.edges.where("src = dst"))
    v = F.sum("weight") if "weight" in e.columns else F.count("*")
    return e.groupBy(F.col("src").alias("i"), F.col("dst").alias("j")).agg(v.cast("double").alias("v"))


def spmv(matrix: DataFrame, x: DataFrame, transpose: bool = False) -> DataFrame:
    """``(id, value)``: the product of ``matrix (i, j, v)`` and ``x (id, value)``; zero rows are left out."""
    row, col = ("j", "i") if transpose else ("i", "j")
    return matrix.join(x.select(F.col("id").alias(col), "value"), col).groupBy(F.col(row).alias("id")).agg(
        F.sum(F.col("v") * F.col("value")).alias("value"))


def multiply(graph: Graph, x: DataFrame | None = None, transpose: bool = False) -> DataFrame:
    """``(id, value)`` of every vertex: A x, or A transposed x; ``x`` is all ones by default."""
    if x is None:
        x = graph.vertices.select("id", F.lit(1.0).alias("value"))
    got = spmv(sparse_matrix(graph), x, transpose)
    return graph.vertices.join(got, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"))


@dataclass
class Embedding:
    """``values`` by falling importance, and vectors as ``(id, rank, value)``; ``right`` for singular pairs only."""

    values: list[float]
    left: DataFrame
    right: DataFrame | None
    variant: str

    @property
    def vectors(self) -> DataFrame:
        return self.left


def _operators(graph: Graph, variant: str, c: float):
    """The matrix to decompose as ``(i, j, v)``, and how its eigenvalues become the variant's."""
    a = sparse_matrix(graph)
    ids = graph.vertices
    d = ids.join(a.groupBy("i").agg(F.sum("v").alias("d")).withColumnRenamed("i", "id"), "id", "left").fillna(0.0, ["d"])
    diagonal = lambda v: d.select(F.col("id").alias("i"), F.col("id").alias("j"), v.alias("v"))
    if variant == "A":
        return a, "largest magnitude"
    if variant == "Aug":
        return _added(a, diagonal(F.col("d") * c)), "largest magnitude"
    if graph.directed:
        raise ValueError(f"{variant} needs an undirected graph")
    if variant == "L":
        return _added(a.select("i", "j", (-F.col("v")).alias("v")), diagonal(F.col("d"))), "smallest"
    root = d.where("d > 0").select("id", (1 / F.sqrt("d")).alias("r"))
    n = a.join(root.select(F.col("id").alias("i"), F.col("r").alias("ri")), "i").join(
        root.select(F.col("id").alias("j"), F.col("r").alias("rj")), "j").select(
        "i", "j", (-F.col("v") * F.col("ri") * F.col("rj")).alias("v"))
    return _added(n, diagonal(F.when(F.col("d") > 0, 1.0).otherwise(0.0))), "smallest"


def _added(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("i", "j").agg(F.sum("v").alias("v"))


def spectral_embedding(graph: Graph, nev: int, which: str = "A", c: float | None = None, ncv: int | None = None,
                       tol: float = 1e-12, max_steps: int = 300) -> Embedding:
    """Leading eigenpairs, or singular triplets for directed graphs.

    ``A``: adjacency. ``Aug``: adjacency plus ``c`` times the degree diagonal
    (``c`` is one over the number of vertices by default). ``L`` and ``nL``: the
    Laplacian and the normalised Laplacian of undirected graphs, smallest
    eigenvalues first; an isolated vertex has a zero row. Each vector's sign
    makes its component of largest magnitude positive. ``ncv`` is the least
    number of steps of a search before convergence is tested (``2 * nev``).
    """
    if which not in ("A", "Aug", "L", "nL"):
        raise ValueError("which must be A, Aug, L or nL")
    if nev < 1:
        raise ValueError("nev must be at least 1")
    n = graph.vcount
    nev = min(nev, n)
    scratch = Scratch(graph.spark, "spectral")
    matrix, end = _operators(graph, which, 1.0 / max(n, 1) if c is None else c)
    matrix = scratch.save(matrix, "matrix")
    ids = scratch.save(graph.vertices.select("id"), "ids")
    return _solve(graph, matrix, ids, nev, end, which, ncv or 2 * nev, tol, max_steps, scratch)


def _pick(values: np.ndarray, nev: int, end: str) -> np.ndarray:
    return np.argsort(values, kind="stable")[:nev] if end == "smallest" else np.argsort(-np.abs(values), kind="stable")[:nev]


def _dots(met: DataFrame, step: int) -> np.ndarray:
    """The products of ``w`` with the basis vectors, and with itself at the end."""
    each = met.select("w", F.posexplode(F.concat("b", F.array("w"))).alias("p", "x"))
    got = each.groupBy("p").agg(F.sum(F.col("w") * F.col("x")).alias("dot")).collect()
    out = np.zeros(step + 1)
    for r in got:
        out[r.p] = r.dot
    return out


def _less(met: DataFrame, h: np.ndarray) -> DataFrame:
    """``w`` without its parts along the basis."""
    along = F.aggregate(F.zip_with("b", F.array(*[F.lit(float(x)) for x in h]), lambda x, y: x * y), F.lit(0.0),
                        lambda t, x: t + x)
    return met.withColumn("w", F.col("w") - along)


def _solve(graph, matrix, ids, nev, end, which, ncv, tol, max_steps, scratch) -> Embedding:
    """Krylov vectors with full reorthogonalisation; the basis stays a table ``(id, b array<double>)``.

    Only the projected matrix and a step's dot products come to the driver. When
    the wanted values have settled the search goes on from a fresh vector, and
    ends when that finds none to take their place; so values that occur several
    times, as those of like components do, are all found.
    """
    apply = (lambda x: spmv(matrix, spmv(matrix, x, True))) if graph.directed else (lambda x: spmv(matrix, x))
    n = graph.vcount

    def fresh(seed: int):
        return (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_003)) / 1_000_003) - 0.5

    start = ids.select("id", fresh(1).alias("value"))
    norm = start.agg(F.sqrt(F.sum(F.col("value") ** 2))).first()[0] or 1.0
    basis = scratch.save(start.select("id", F.array(F.col("value") / norm).alias("b")), "basis")
    projected, loose, settled, since = np.zeros((0, 0)), {}, None, 0
    for step in range(1, min(max_steps, n) + 1):
        since += 1
        w = apply(basis.select("id", F.element_at("b", -1).alias("value")))
        met = scratch.save(basis.join(w, "id", "left").select("id", "b", F.coalesce("value", F.lit(0.0)).alias("w")), "w")
        h = _dots(met, step)[:-1]
        grown = np.zeros((step, step))
        grown[:-1, :-1] = projected
        grown[-1, :] = grown[:, -1] = h
        projected = grown
        left = _less(met, h)
        again = _dots(left, step)  # orthogonalise twice
        left = _less(left, again[:-1])
        size = max(again[-1] - (again[:-1] ** 2).sum(), 0.0) ** 0.5
        values, s = np.linalg.eigh(projected)
        best = _pick(values, nev, end)
        scale = max(np.abs(values).max(), 1e-300)
        off = np.sqrt(sum((x * s[j, best]) ** 2 for j, x in {**loose, step - 1: size}.items()))
        ended = size <= 1e-10 * scale
        if step == n or step == max_steps:
            break
        if ended or (step >= nev and since >= ncv and (off <= tol * scale).all()):
            found = values[best]
            if step >= nev and settled is not None and len(settled) == len(found) and np.abs(found - settled).max() <= 1e-7 * scale:
                break
            # a vector of its own, free of all that is known, begins the next search
            settled, since, loose[step - 1] = found, 0, 0.0 if ended else size
            left = met.withColumn("w", fresh(step + 1))
            for _ in range(2):
                dots = _dots(left, step)
                left = _less(left, dots[:-1])
            size = _dots(left, step)[-1] ** 0.5
        nxt = scratch.save(left.select("id", F.concat("b", F.array(F.col("w") / size)).alias("b")), "basis")
        scratch.drop(basis)
        scratch.drop(met)
        basis = nxt
    coefficients = s[:, best]
    vectors = basis
    cols = [sum((F.lit(float(coefficients[j, k])) * F.col("b")[j] for j in range(len(coefficients))), F.lit(0.0))
            for k in range(len(best))]
    wide = scratch.save(vectors.select("id", F.array(*cols).alias("x")), "vectors")
    long = wide.select("id", F.posexplode("x").alias("p", "value")).select("id", (F.col("p") + 1).alias("rank"), "value")
    top = long.groupBy("rank").agg(F.max_by("value", F.struct(F.abs("value"), -F.col("id"))).alias("t"))
    left = long.join(F.broadcast(top), "rank").select(
        "id", "rank", (F.col("value") * F.when(F.col("t") < 0, -1.0).otherwise(1.0)).alias("value"))
    if not graph.directed:
        return Embedding(values[best].tolist(), left, None, which)
    left = scratch.save(left, "left")
    back = matrix.join(left.select(F.col("id").alias("i"), "rank", "value"), "i").groupBy(
        F.col("j").alias("id"), "rank").agg(F.sum(F.col("v") * F.col("value")).alias("value"))
    size = back.groupBy("rank").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("n"))
    right = back.join(F.broadcast(size), "rank").select("id", "rank", (F.col("value") / F.col("n")).alias("value"))
    return Embedding(np.sqrt(np.maximum(values[best], 0)).tolist(), left, right, which)
