"""Near-duplicates by SimHash, joined through segment popcounts.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the
vector of the segments' bit counts. The Manhattan distance of two embeddings
never exceeds the Hamming distance of the fingerprints, so a range join of the
embeddings loses no link. The grid groups the 32 coordinates into slabs; of
``g`` slabs at most four can differ within distance four, so two fingerprints in
range agree on some ``g - 4`` slabs and meet in the grid cell of that choice.
Inside a cell the Manhattan bound comes first, then the exact bit count. The
number of slabs is fixed. A cell with too many members for one task is cut by a
finer grid of its own, over the fingerprints' bits: of its slabs, too, at most
four differ, so no link is lost and every member is written a fixed number of
times, however crowded the cell.

Defined cases: null and wordless texts have fingerprint zero and link like any
other; equal fingerprints are one node, so copies are never expanded into
pairs; rows repeat in the result as they do in the input; a null ``doc_id``
keeps its row and takes the component of its fingerprint (null if no row of the
component has an id); texts of any length are read whole, and a bit set in
exactly half of the shingles' hashes is not set; an empty table gives an empty
result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from vertexloom.llm._arrow import find_package, free_names, map_batches, texts
from vertexloom.operators.components import min_label
from vertexloom.plans.scratch import Scratch

SEED = 42
#: Slabs of the grid beyond the radius: 6 for radius 4, the cheapest on the sizes measured.
MORE_SLABS = 2
#: Members of a grid cell that one task compares; a cell with more is cut by the next of the finer grids.
CELL_ROWS = 4096
#: Slabs beyond the radius of the finer grids over bits, each cutting the cells that the one before leaves crowded.
FINER = (2, 3, 5)
#: Cells up to this size are compared pair by pair; larger ones by growing a spanning forest.
PAIRWISE = 64
_LOW = 0x5555555555555555
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str, words: int = 4, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    n = len(parts)
    joined = b" ".join(parts)
    if n <= words:
        hashed = xxhash.xxh64_digest(joined, seed)
        count = 1
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
        starts = np.empty(n, np.int64)
        starts[0], starts[1:] = 0, ends[:-1] + 1
        digest = xxhash.xxh64_digest
        hashed = b"".join([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1:].tolist())])
        count = n - words + 1
    seen = np.frombuffer(hashed, np.uint8).reshape(-1, 8)
    counts = np.bincount((seen + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits((2 * counts > count).ravel()).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``(doc_id, fp)``: one row per document, ``fp`` as a signed long."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, words) for t in texts(batch.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                       kernel, "doc_id long, fp long")


def _masks(slabs: int, radius: int, width: int) -> list[int]:
    """For each choice of ``slabs - radius`` slabs of 64 bits, the mask of their bits; slabs are runs of ``width``-bit units."""
    units = 64 // width
    edges = [round(i * units / slabs) * width for i in range(slabs + 1)]
    slab = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(slabs)]
    return [_signed(sum(c)) for c in combinations(slab, slabs - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedding(fp: F.Column | str):
    """Segment popcounts of a fingerprint as one long: each two-bit segment holds its count in unary.

    The bit count of the exclusive or of two such longs is the Manhattan
    distance of the two popcount vectors.
    """
    c = F.col(fp) if isinstance(fp, str) else fp
    low, shifted = F.lit(_LOW), F.shiftrightunsigned(c, 1)
    both = c.bitwiseAND(shifted).bitwiseAND(low)
    return c.bitwiseOR(shifted).bitwiseAND(low).bitwiseOR(F.shiftleft(both, 1))


def _np_embedding(fp: np.ndarray) -> np.ndarray:
    low, one = np.uint64(_LOW), np.uint64(1)
    return ((fp | fp >> one) & low) | (((fp & fp >> one) & low) << one)


def _near(a: np.ndarray, b: np.ndarray, ea: np.ndarray, eb: np.ndarray, radius: int) -> np.ndarray:
    """The Manhattan bound of the embeddings, then the exact distance of what passes it."""
    ok = np.bitwise_count(ea ^ eb) <= radius
    where = np.flatnonzero(ok)
    ok[where] = np.bitwise_count(a[where] ^ np.broadcast_to(b, a.shape)[where]) <= radius
    return ok


def _forest(fp: np.ndarray, emb: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected within the cell: each node meets only nodes not yet reached."""
    left = np.arange(len(fp))
    us, vs = [], []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            hit = _near(fp[left], fp[x], emb[left], emb[x], radius)
            found = left[hit]
            if len(found):
                left = left[~hit]
                todo.extend(found.tolist())
                us.append(np.full(len(found), x))
                vs.append(found)
    empty = np.empty(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (empty, empty)


def _links(keys: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows with equal keys (sorted) that are in range."""
    emb = _np_embedding(fp)
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[start, len(keys)])
    us, vs = [], []
    group = np.repeat(size, size)
    place = np.arange(len(keys)) - np.repeat(start, size)
    small = group <= PAIRWISE
    for step in range(1, min(PAIRWISE, int(size.max(initial=0)))):
        i = np.flatnonzero(small & (place + step < group))
        if not len(i):
            break
        ok = _near(fp[i], fp[i + step], emb[i], emb[i + step], radius)
        us.append(i[ok])
        vs.append(i[ok] + step)
    for s, n in zip(start[size > PAIRWISE].tolist(), size[size > PAIRWISE].tolist()):
        u, v = _forest(fp[s:s + n], emb[s:s + n], radius)
        us.append(u + s)
        vs.append(v + s)
    empty = np.empty(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (empty, empty)


def _link_cells(radius: int):
    """Batches of ``(cell, fp, node)`` sorted by cell, to links; the last cell waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3

        def emit(cols: list[np.ndarray]) -> pa.RecordBatch | None:
            cell, fp, node = cols
            u, v = _links(cell, fp.view(np.uint64), radius)
            if not len(u):
                return None
            pairs = np.unique(np.stack([np.maximum(node[u], node[v]), np.minimum(node[u], node[v])], 1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            held = [np.concatenate([a, b]) for a, b in zip(held, new)]
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                out = emit([x[:cut] for x in held])
                held = [x[cut:] for x in held]
                if out is not None and out.num_rows:
                    yield out
        if len(held[0]):
            out = emit(held)
            if out is not None and out.num_rows:
                yield out

    return run


def _cells(members: DataFrame, over, masks: list[int], *within: str) -> DataFrame:
    """``(cell, fp, node)``: each member under its cell of every choice of slabs, within the cell it comes from."""
    parts = F.posexplode(F.array(*[over.bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "part")
    return members.select("fp", "node", *within, parts).select(
        F.xxhash64(*within, "choice", "part").alias("cell"), "fp", "node")


def links(nodes: DataFrame, scratch: Scratch, radius: int = 4) -> DataFrame:
    """Links ``(u, v)``, ``u > v``, between nodes ``(fp, node)`` with distinct ``fp``.

    They connect exactly what distance ``radius`` or less connects; within a
    cell of many members redundant links are left out. Cells are counted, with
    partial sums, before any of them is gathered. What the last of the finer
    grids leaves crowded differs in few bits and is gathered nevertheless.
    """
    cells = _cells(nodes, embedding("fp"), _masks(radius + MORE_SLABS, radius, 2))
    ready = None
    for more in (*FINER, None):
        if more is None:
            part, cells = cells, None
        else:
            crowded = scratch.save(cells.groupBy("cell").count().where(F.col("count") > CELL_ROWS).select("cell"), "crowded")
            if crowded.limit(1).count():
                part = cells.join(crowded, "cell", "left_anti")
                cells = cells.join(crowded, "cell", "left_semi").withColumnRenamed("cell", "outer")
                cells = scratch.save(_cells(cells, F.col("fp"), _masks(radius + more, radius, 1), "outer"), "finer")
            else:
                part, cells = cells, None
        ready = part if ready is None else ready.unionByName(part)
        if cells is None:
            break
    find_package(nodes.sparkSession)
    dealt = ready.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(_link_cells(radius), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                    radius: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row.

    Fingerprints at ``radius`` or fewer differing bits link; ``component_id`` is
    the smallest id reachable, the row's own included.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs, id_col, text_col, words), "prints")
    groups = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("low")).select(
        "fp", F.coalesce("low", F.xxhash64("fp").bitwiseOR(F.lit(-1 << 63)) ).alias("node"), "low"), "groups")
    found = scratch.save(links(groups, scratch, radius), "links")
    comps = min_label(found, scratch)
    named = groups.join(comps.withColumnRenamed("id", "node"), "node", "left").select(
        F.col("fp").alias("fp2"), F.coalesce("component", "node").alias("root"), "low")
    # nodes without any id carry a negative stand-in; a component takes its smallest real id
    best = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.where("root >= 0").select("fp2", F.col("root").alias("component_id")).union(
        named.where("root < 0").join(best, "root").select("fp2", "component_id"))
    return prints.join(named, F.col("fp") == F.col("fp2")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the smallest id of each near-duplicate group; a repeated row of it stays once.

    Rows without an id cannot be named and all stay. Rows that share an id but
    not the text stay side by side.
    """
    scratch = Scratch(docs.sparkSession, "simhash-keep")
    marked = scratch.save(near_duplicates(docs, id_col, text_col), "components")
    kept = marked.where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    # the text's hash goes with the id that the join deals out by, so telling repeats apart takes no further shuffle
    (mark,) = free_names(docs.columns, "text_hash")
    same = docs.withColumn(mark, F.xxhash64(text_col)).join(kept, id_col, "left_semi").dropDuplicates([id_col, mark])
    return same.select(docs.columns).unionAll(docs.where(F.col(id_col).isNull()))
