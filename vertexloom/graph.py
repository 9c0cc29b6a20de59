"""The graph handle: two DataFrames and a direction flag."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F


class Graph:
    """``vertices (id)`` and ``edges (src, dst[, weight])``.

    An undirected graph keeps each edge once with ``src <= dst``; ``sym`` holds
    both directions. Ids are 64-bit and used as they are in the edge table.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame, directed: bool = True,
                 name: str = "graph", in_mem: bool = False):
        self.vertices, self.edges = vertices, edges
        self.directed, self.name, self.in_mem = directed, name, in_mem

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @classmethod
    def from_edges(cls, df: DataFrame, src: str = "src", dst: str = "dst", *, weight: str | None = None,
                   directed: bool = True, base: int = 0, vertices: DataFrame | None = None,
                   dense: bool = False, name: str = "graph") -> Graph:
        """Build a graph from an edge frame.

        ``base=1`` shifts one-based ids down. Vertices are the ids present in the
        edges, the given ``vertices (id)``, or with ``dense=True`` every id from
        zero to the largest. Rows with a null endpoint are dropped; duplicate
        edges and loops stay (see ``simplify``).
        """
        cols = [(F.col(src).cast("long") - base).alias("src"), (F.col(dst).cast("long") - base).alias("dst")]
        if weight:
            cols.append(F.col(weight).alias("weight"))
        edges = df.select(*cols).where("src is not null and dst is not null")
        if not directed:
            rest = ["weight"] if weight else []
            edges = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *rest)
        if vertices is not None:
            ids = vertices.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct()
        elif dense:
            top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
            ids = df.sparkSession.range(0, 0 if top is None else top + 1)
        else:
            ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        return cls(ids, edges, directed, name)

    @cached_property
    def sym(self) -> DataFrame:
        """``(src, dst[, weight])`` in both directions; a loop appears twice, as its degree counts."""
        flip = [F.col("dst").alias("src"), F.col("src").alias("dst")] + [
            F.col("weight")] * ("weight" in self.edges.columns)
        return self.edges.unionAll(self.edges.select(*flip))

    @cached_property
    def links(self) -> DataFrame:
        """Distinct undirected neighbour pairs in both directions, without loops: ``(src, dst)``."""
        return self.sym.where("src <> dst").select("src", "dst").distinct()

    def simplify(self) -> Graph:
        """Without loops and repeated edges; weights of repeats are summed."""
        edges = self.edges.where("src <> dst")
        if "weight" in edges.columns:
            edges = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
        else:
            edges = edges.distinct()
        return Graph(self.vertices, edges, self.directed, self.name, self.in_mem)

    def need_directed(self, what: str) -> None:
        if not self.directed:
            raise ValueError(f"{what} needs a directed graph")

    def persist(self) -> Graph:
        """Keep both tables in memory, spilling to disk."""
        self.vertices, self.edges = self.vertices.persist(), self.edges.persist()
        self.in_mem = True
        return self

    def unpersist(self) -> Graph:
        self.vertices.unpersist()
        self.edges.unpersist()
        self.in_mem = False
        return self

    @cached_property
    def vcount(self) -> int:
        return self.vertices.count()

    @cached_property
    def ecount(self) -> int:
        """Edges; each undirected edge counts once."""
        return self.edges.count()

    def __repr__(self) -> str:
        return f"Graph {self.name} ({'D' if self.directed else 'U'}): {self.vcount} {self.ecount}"
