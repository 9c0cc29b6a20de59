"""Exact top-k inner products by MaxScore over shards.

Dimensions are the terms, and a term's posting list is the column of its
components over a shard's rows. In a shard, a term's contribution to a query's
score lies between two bounds. Terms are ordered by what lies between their
bounds; those whose gaps together cannot lift a row from the least score to the
query's current k-th best are non-essential. Only the essential postings are
traversed. The others are probed, in order of falling gap, for rows whose score
so far plus the bounds still open can reach the k-th best. A task keeps a
query's best rows from one shard to the next, so the bar rises as it goes, and
hands on ``k`` rows a query; tasks' lists are merged by score, ties to the
smaller id.

Defined cases: a vector that is null or holds a null or non-finite component
takes no part, as query or as candidate, nor does a row without an id; shorter
vectors count as padded with zeros; rows with the query's own id are not its
candidates; a repeated row counts as often as it occurs, as candidate and as
query (every copy of a query ranks all candidates, and the copies' lists share
the ``k`` places); with fewer candidates than ``k`` all are returned; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vertexloom.llm._arrow import find_package, slices

#: Rows of a shard, and queries of a block: what one task holds of either at a time.
SHARD_ROWS, QUERY_ROWS = 4096, 512
#: Non-essential terms probed between two looks at which rows are still competitive.
PROBE = 4


def _pack(rows: int):
    """Batches of ``(vec_id, vector)`` to blocks ``(ids, data, dims)`` of ``rows`` rows, a task's last one with the rest."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held])
        size = np.concatenate([b.column(1).value_lengths().to_numpy(zero_copy_only=False) for b in held])
        flat = np.concatenate([b.column(1).flatten().to_numpy(zero_copy_only=False) for b in held])
        dims = int(size.max(initial=0))
        out = np.zeros((len(ids), dims), np.int64)
        out[np.arange(dims) < size[:, None]] = flat
        return pa.RecordBatch.from_arrays(
            [pa.array([ids.tobytes()], pa.binary()), pa.array([_narrow(out)], pa.binary()), pa.array([dims], pa.int32())],
            names=["ids", "data", "dims"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in slices(batches, rows):
            while batch.num_rows:
                take = batch.slice(0, rows - n)
                batch = batch.slice(take.num_rows)
                held.append(take)
                n += take.num_rows
                if n == rows:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return run


def _narrow(block: np.ndarray) -> bytes:
    """The block in the smallest integer type that holds it, named by its first byte."""
    for code, t in ((1, np.int8), (2, np.int16), (4, np.int32)):
        if not block.size or (block.min() >= np.iinfo(t).min and block.max() <= np.iinfo(t).max):
            return bytes([code]) + block.astype(t).tobytes()
    return bytes([8]) + block.tobytes()


def _wide(data: bytes, rows: int, dims: int) -> np.ndarray:
    t = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[data[0]]
    return np.frombuffer(data, t, offset=1).reshape(rows, dims)


def _exact_type(q: np.ndarray, c: np.ndarray):
    """The fastest type in which every score is exact."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * max(1, q.shape[1])
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


class Block:
    """A block of queries with the best ``k`` rows each has met so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]  # (ids, scores), the k-th last

    def meet(self, c_ids: np.ndarray, c: np.ndarray) -> None:
        """Let the rows of a shard compete."""
        dims = min(self.vectors.shape[1], c.shape[1])  # what one side lacks is zero
        kind = _exact_type(self.vectors[:, :dims], c[:, :dims])
        q, postings = self.vectors[:, :dims].astype(kind), np.ascontiguousarray(c[:, :dims].T.astype(kind))
        high, low = postings.max(1), postings.min(1)
        most, least = np.maximum(q * high, q * low), np.minimum(q * high, q * low)
        order = np.argsort(least - most, axis=1, kind="stable")  # terms by falling gap
        for i in range(len(q)):
            ids, scores = self.best[i]
            if len(ids) < self.k:  # no bar yet: every row is scored
                rows = np.flatnonzero(c_ids != self.ids[i])
                self._keep(i, c_ids[rows], (q[i] @ postings)[rows].astype(np.int64))
                continue
            bar, by = scores[-1], order[i]
            gaps = (most[i] - least[i])[by]
            reach = np.cumsum(gaps[::-1])[::-1]  # what the terms from here on can add to the least score
            essential = int(np.count_nonzero(reach >= bar - least[i].sum()))
            so_far = q[i, by[:essential]] @ postings[by[:essential]] if essential else np.zeros(len(c_ids), kind)
            left = most[i, by[essential:]].sum()
            rows = np.flatnonzero((so_far + left >= bar) & (c_ids != self.ids[i]))
            got = so_far[rows]
            for j in range(essential, dims, PROBE):
                if not len(rows):
                    break
                terms = by[j:j + PROBE]
                got = got + q[i, terms] @ postings[np.ix_(terms, rows)]
                left = left - most[i, terms].sum()
                alive = got + left >= bar
                rows, got = rows[alive], got[alive]
            if len(rows):
                self._keep(i, c_ids[rows], got.astype(np.int64))

    def _keep(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(scores) > self.k:  # those below the k-th best of the new ones cannot stay
            bar = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[scores >= bar], scores[scores >= bar]
        ids, scores = np.concatenate([self.best[i][0], ids]), np.concatenate([self.best[i][1], scores])
        first = np.lexsort((ids, -scores))[:self.k]
        self.best[i] = ids[first], scores[first]

    def rows(self) -> pa.RecordBatch:
        n = [len(ids) for ids, _ in self.best]
        cols = [np.repeat(self.ids, n), *(np.concatenate([b[j] for b in self.best]) for j in range(2))]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["query_id", "vec_id", "score"])


def _search(k: int):
    """Pairs of a query block and a shard, those of one block together, to the block's best rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for batch in slices(batches, 1):
            q_raw, q_data, q_dims, c_raw, c_data, c_dims = (batch.column(i)[0].as_py() for i in range(6))
            if at != (q_raw, q_data):
                if block is not None:
                    yield block.rows()
                ids = np.frombuffer(q_raw, np.int64)
                at, block = (q_raw, q_data), Block(ids, _wide(q_data, len(ids), q_dims), k)
            ids = np.frombuffer(c_raw, np.int64)
            block.meet(ids, _wide(c_data, len(ids), c_dims))
        if block is not None:
            yield block.rows()

    return run


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` best rows by integer inner product.

    ``is_query`` is a condition on the id column. Components become
    ``floor(scale * x)``. Shards are dealt to groups and every query block goes
    to every group, so both sides are bounded per task however many there are;
    the merge join hands a task its pairs block by block.
    """
    find_package(vectors.sparkSession)
    x = F.col("v")
    whole = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(
        F.col("id").isNotNull() & x.isNotNull()
        & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))).select(
        "id", F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))
    blocks, n = "ids binary, data binary, dims int", _groups(vectors)
    shards = whole.mapInArrow(_pack(SHARD_ROWS), blocks).select(
        F.col("ids").alias("c_ids"), F.col("data").alias("c_data"), F.col("dims").alias("c_dims"),
        F.pmod(F.xxhash64("ids", "data"), F.lit(n)).alias("g")).repartition(n, "g")
    asked = whole.where(is_query(F.col("id"))).coalesce(n).mapInArrow(_pack(QUERY_ROWS), blocks).select(
        F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("dims").alias("q_dims"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("g")).repartition(n, "g")
    met = asked.hint("merge").join(shards, "g").select("q_ids", "q_data", "q_dims", "c_ids", "c_data", "c_dims")
    best = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _groups(df: DataFrame) -> int:
    """Groups of shards: as many as the session's shuffle partitions, so their tasks spread over the cluster."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
