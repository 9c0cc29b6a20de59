"""Benchmark decontamination by latent semantic retrieval.

Benchmark items and document passages are TF-IDF vectors over the items' own
words (a word that no item has adds to no similarity with an item); document
frequencies are counted over all documents. A randomised SVD of the passages of
all documents gives the latent space: every task sums its share of the products
with a small random matrix, the sums meet in a fixed-size matrix, and a QR and a
small SVD follow. Passages are windows of whole texts in three lengths; those whose latent
cosine with an item passes a threshold are candidates. A candidate, with the
block before and the block after it, must then hold enough of the item in order
(longest common subsequence of words) and the item's answer; the two blocks give
room to words that a paraphrase inserts.

Defined cases: null and empty texts hold nothing; items without an id, without a
text or without a word are left out, and items with equal words share a result
under the smallest id; an item's answer is its last ``ANSWER_WORDS`` words unless
a column gives it; texts are searched whole, in pieces of a fixed size; of
several places of an item in a text the best share counts; repeated rows give
equal results; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vertexloom.llm._arrow import find_package, map_batches, slices, texts
from vertexloom.plans.scratch import Scratch

#: Words of a block; a passage is a run of blocks and starts at every block.
BLOCK = 16
#: Passages of this many blocks, for items of up to so many words that one passage holds them wherever they start.
SPANS = (2, 3, 5)
ITEM_WORDS = (SPANS[-1] - 1) * BLOCK
RANK, OVERSAMPLE, POWER = 128, 8, 1
#: Words in more than this share of documents weigh nothing, unless an item would keep fewer than MIN_WORDS others.
COMMON, MIN_WORDS = 0.1, 5
COSINE = 0.35
#: The share of an item's words that must appear in order, and the least share with its whole answer.
LCS, LCS_ANSWERED = 0.8, 0.6
ANSWER_WORDS = 5
#: Items compared in one pass over the documents; more items take more passes. Tables of items by words are dense.
ITEM_BLOCK = 1000

#: Passages whose share in the latent space is computed together.
FIT_PASSAGES = 512
#: Memory that one piece of the candidates' exact checks takes.
CHECK_BYTES = 16 << 20

_FOLD = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256)).lower()


def words(text: str) -> list[bytes]:
    """Lower-case words as UTF-8: runs of letters, digits and non-ASCII characters."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class Items:
    """Benchmark passages and the latent space, small and shared with every task."""

    ids: np.ndarray
    sequences: list[list[int]]
    answers: list[list[int]]
    vocabulary: dict[bytes, int]
    idf: np.ndarray | None = None
    space: np.ndarray | None = None  # (words + 1) x rank: a word's weight times its latent vector
    latent: np.ndarray | None = None  # items x rank, of length one
    _matcher: Matcher | None = None

    def matcher(self) -> Matcher:
        """Built once in each process that holds the items."""
        if self._matcher is None:
            self._matcher = Matcher(self)
        return self._matcher

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(item index, word, how often)`` for the words that each item has, in order."""
        keys = np.concatenate([np.unique(s, return_counts=True) for s in map(np.asarray, self.sequences)], axis=1)
        items = np.repeat(np.arange(len(self.sequences)), [len(set(s)) for s in self.sequences])
        return items, keys[0], keys[1].astype(np.float32)


def _times(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """The product of a sparse matrix of ``n`` rows, all of them present and in order, with a dense one."""
    return np.add.reduceat(values[:, None] * x[cols], np.searchsorted(rows, np.arange(n)), axis=0)


def read_items(rows: list[tuple]) -> Items:
    """Items from ``(item_id, text, answer or None)``; long items become several passages."""
    vocabulary: dict[bytes, int] = {}
    ids, sequences, answers, seen = [], [], [], {}
    for item, text, answer in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or "")):
        w = [vocabulary.setdefault(x, len(vocabulary) + 1) for x in words(text or "")]
        if not w or tuple(w) in seen:
            continue
        seen[tuple(w)] = item
        tail = [vocabulary.setdefault(x, len(vocabulary) + 1) for x in words(answer or "")] or w[-ANSWER_WORDS:]
        parts = [w] if len(w) <= ITEM_WORDS else [
            w[a:a + ITEM_WORDS] for a in range(0, len(w) - ITEM_WORDS // 2, ITEM_WORDS // 2)]
        for p in parts:
            ids.append(item)
            sequences.append(p)
            answers.append(tail if len(parts) == 1 else p[-ANSWER_WORDS:])
    return Items(np.array(ids, np.int64), sequences, answers, vocabulary)


def _ids(vocabulary: dict, text: str) -> np.ndarray:
    w = words(text)
    return np.fromiter(map(vocabulary.get, w, repeat(0)), np.int32, len(w))


def coded_words(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, codes)``: each row's item words by number, 0 for any other word.

    A task's last row has, in place of codes, in how many of its rows each item
    word occurs, and their number first; so one pass over the texts serves both.
    """
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)
    find_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(len(known) + 1, np.int64)
        for batch in slices(batches):
            out = []
            for t in texts(batch.column(1)):
                c = _ids(known, t)
                met = np.bincount(c, minlength=len(total)) > 0
                met[0] = True
                total += met
                out.append(c.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.binary()), pa.nulls(len(out), pa.binary())],
                names=["doc_id", "codes", "counts"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([total.tobytes()], pa.binary())],
            names=["doc_id", "codes", "counts"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, codes binary, counts binary")


def _summed(width: int, kind):
    """Adds up the fixed-size matrices of a partition's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, kind)
        for batch in slices(batches, 16):
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, kind)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    return run


def _tree_sum(parts: DataFrame, width: int, kind) -> np.ndarray:
    """The sum of many fixed-size matrices: in groups on the executors, then of one matrix a group."""
    grouped = parts.coalesce(16).mapInArrow(_summed(width, kind), "part binary")
    return sum((np.frombuffer(r.part, kind) for r in grouped.toLocalIterator()), np.zeros(width, kind))


def _products(row: np.ndarray, word: np.ndarray, value: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``row^T (row x)`` summed over sparse rows, numbered from 0 in order: the words they have, and these words' sums."""
    flip = np.argsort(word, kind="stable")
    used, place = np.unique(word[flip], return_inverse=True)
    met = _times(row, word, value, x, int(row[-1]) + 1)
    return used, _times(place, row[flip], value[flip], met, len(used))


def _unit(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The values of sparse rows, numbered from 0, with each row brought to length one."""
    return (value / np.maximum(np.sqrt(np.bincount(row, value * value)), 1e-9)[row]).astype(np.float32)


def _add_products(coded: list[np.ndarray], idf: np.ndarray, x: np.ndarray, total: np.ndarray) -> None:
    """Adds to ``total`` the products of the texts' passages, one after the other from each text's start."""
    width = BLOCK * SPANS[1]
    size = np.array([len(c) for c in coded])
    own = -(-size // width)
    flat = np.concatenate(coded)
    passage = np.repeat(np.cumsum(own) - own, size) + (np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)) // width
    kept = np.flatnonzero(idf[flat] > 0)
    flat, passage = flat[kept], passage[kept]
    cuts = np.searchsorted(passage, np.arange(0, own.sum() + FIT_PASSAGES, FIT_PASSAGES))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if a < b:
            keys, often = np.unique(passage[a:b] * len(idf) + flat[a:b], return_counts=True)
            row, word = np.unique(keys // len(idf), return_inverse=True)[1], keys % len(idf)
            used, sums = _products(row, word, _unit(row, often * idf[word]), x)
            total[used] += sums


def _weights(items: Items, df: np.ndarray) -> np.ndarray:
    """Inverse document frequencies; common words weigh nothing where their items have enough others."""
    n = max(int(df[0]), 1)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + 0.01
    idf[0] = 0
    common = df > COMMON * n
    for s in items.sequences:
        distinct = np.unique(s)
        if (~common[distinct]).sum() < MIN_WORDS:
            rarest = distinct[np.argsort(df[distinct], kind="stable")[:MIN_WORDS]]
            common[rarest] = False
    idf[common] = 0
    return idf


def fit_space(coded: DataFrame, items: Items, scratch: Scratch) -> Items:
    """The latent space by a distributed randomised SVD of the TF-IDF passages.

    Passages come from all documents and from the items themselves. In a round
    every task adds ``row^T (row X)`` over its passages: one matrix of words x
    rank, whatever the number of documents.
    """
    spark = coded.sparkSession
    width = len(items.vocabulary) + 1
    df = _tree_sum(coded.where("counts is not null").select("counts"), width, np.int64)
    idf = items.idf = _weights(items, df)
    rank = min(RANK + OVERSAMPLE, width)
    x = np.random.default_rng(3).normal(size=(width, rank))
    n_items = len(items.ids)
    row, word, often = items.counts()
    weight = _unit(row, often * idf[word])

    for _ in range(POWER + 1):
        shared = spark.sparkContext.broadcast((idf, np.linalg.qr(x)[0].astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            weight, q = shared.value
            total = np.zeros(q.shape)
            for batch in slices(batches):
                _add_products([np.frombuffer(c, np.int32) for c in batch.column(0).to_pylist()], weight, q, total)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        q = shared.value[1]
        # written first: all passages are read by as many tasks as there are, and only their matrices in groups
        parts = scratch.save(coded.where("codes is not null").select("codes").mapInArrow(run, "part binary"), "products")
        x = _tree_sum(parts, q.size, np.float64).reshape(q.shape).copy()
        scratch.drop(parts)
        # items count as much as the documents do
        used, sums = _products(row, word, weight, q)
        x[used] += sums * (max(int(df[0]), 1) / n_items)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    basis = u[:, :max(1, min(RANK, int((s > s[0] * 1e-6).sum())))].astype(np.float32)
    items.space = basis * idf[:, None]
    latent = _times(row, word, often, items.space, n_items)
    items.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    return items


def lcs_length(a: list[int], b: list[int]) -> int:
    """Longest common subsequence by bit-parallel rows."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        m = places.get(y)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def verify(items: Items, i: int, passage: list[int]) -> float:
    """The item's share found in order if the passage passes the length and answer checks, else zero."""
    s = items.sequences[i]
    share = lcs_length(s, passage) / len(s)
    if share >= LCS:
        return share
    if share >= LCS_ANSWERED:
        answer = items.answers[i]
        if lcs_length(answer, passage) == len(answer):
            return share
    return 0.0


class Matcher:
    """Finds the items in batches of coded texts."""

    def __init__(self, items: Items):
        self.items = items
        size = np.array([len(s) for s in items.sequences])
        reach = [(b - 1) * BLOCK for b in SPANS]
        of = np.searchsorted(reach, size)
        self.scales = [(b, np.flatnonzero(of == k)) for k, b in enumerate(SPANS) if (of == k).any()]
        row, word, _ = items.counts()
        self.has = np.zeros((len(size), len(items.vocabulary) + 1), bool)
        self.has[row, word] = True
        self.need = np.ceil(LCS_ANSWERED * size - 1e-9).astype(int)
        self.kept = items.idf > 0
        self.padded = np.zeros((len(size), max(size)), np.int32)
        for i, s in enumerate(items.sequences):
            self.padded[i, :len(s)] = s
        self.probes = 0

    def find(self, coded: list[np.ndarray]) -> list[tuple[int, int, float]]:
        """``(text index, item id, share)``: the best share found of each item in each text."""
        it = self.items
        # texts lie one after the other, each followed by enough empty blocks that no widened passage spans two
        own = np.array([-(-len(c) // BLOCK) for c in coded])
        blocks = own + SPANS[-1]
        first = np.r_[0, np.cumsum(blocks)]
        starts = np.arange(first[-1]) - np.repeat(first[:-1], blocks) < np.repeat(own, blocks)  # not in the empty blocks
        flat = np.zeros(first[-1] * BLOCK + SPANS[-1] * BLOCK, np.int32)
        for c, f in zip(coded, first.tolist()):
            flat[f * BLOCK:f * BLOCK + len(c)] = c
        best: dict[tuple[int, int], float] = {}
        for a in range(0, int(first[-1]), 8192):
            n = min(8192, int(first[-1]) - a)
            piece = flat[a * BLOCK:(a + n + SPANS[-1] - 1) * BLOCK]
            at = np.flatnonzero(self.kept[piece])
            sums = np.zeros((n + SPANS[-1] - 1, it.space.shape[1]), np.float32)
            if not len(at):
                continue
            block = at // BLOCK
            start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            sums[block[start]] = np.add.reduceat(it.space[piece[at]], start, axis=0)
            for span, which in self.scales:
                passage = sums[:n].copy()
                for k in range(1, span):
                    passage += sums[k:k + n]
                length = np.linalg.norm(passage, axis=1)
                some = np.flatnonzero((length > 0) & starts[a:a + n])
                hit, item = np.nonzero(passage[some] @ it.latent[which].T >= COSINE * length[some, None])
                self._check(some[hit] + a, which[item], span, flat, first, best)
        return [(t, i, share) for (t, i), share in best.items()]

    def _check(self, at, item, span, flat, first, best) -> None:
        """Exact checks of candidate passages ``at``, widened by a block on both sides, for ``item``."""
        reach = np.arange(-BLOCK, (span + 1) * BLOCK)  # before the first text lies the empty end of ``flat``
        step = max(1, CHECK_BYTES // max(len(self.kept), len(reach) * 8))
        for a in range(0, len(at), step):
            w, i = at[a:a + step], item[a:a + step]
            window = flat[w[:, None] * BLOCK + reach]
            # words of the passage that the item has bound the common subsequence from above
            ok = np.flatnonzero(self.has[i[:, None], window].sum(1) >= self.need[i])
            w, i, window = w[ok], i[ok], window[ok]
            # and so do the item's words that the passage has
            met = np.zeros((len(ok), len(self.kept)), bool)
            met[np.arange(len(ok))[:, None], window] = True
            met[:, 0] = False
            ok = met[np.arange(len(ok))[:, None], self.padded[i]].sum(1) >= self.need[i]
            for place, k, ids in zip(w[ok].tolist(), i[ok].tolist(), window[ok]):
                self.probes += 1
                share = verify(self.items, k, ids.tolist())
                if share:
                    key = (int(np.searchsorted(first, place, "right")) - 1, int(self.items.ids[k]))
                    best[key] = max(best.get(key, 0.0), share)


def _prepare(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, id_col: str, text_col: str, item_col: str,
             item_text_col: str, answer_col: str | None) -> Iterator[tuple[Items, DataFrame]]:
    """Fitted items with the documents' coded words, block by block of items."""
    picked = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"), (
        F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("answer")).where(
        "item_id is not null and text is not null")
    parts = max(1, -(-picked.count() // ITEM_BLOCK))
    for part in range(parts):
        mine = picked.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        items = read_items([tuple(r) for r in mine.collect()])
        if len(items.ids):
            coded = scratch.save(coded_words(docs, items, id_col, text_col), "coded")
            yield fit_space(coded, items, scratch), coded


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """``(doc_id, item_id, share)``: the items each row's whole text leaks."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, share double"
    out = spark.createDataFrame([], schema)
    scratch = Scratch(spark, "leaks")
    for items, coded in _prepare(docs, benchmark, scratch, id_col, text_col, item_col, item_text_col, answer_col):
        shared = spark.sparkContext.broadcast(items)

        def kernel(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch | None:
            ids = batch.column(0).to_pylist()
            found = shared.value.matcher().find([np.frombuffer(c, np.int32) for c in batch.column(1).to_pylist()])
            if not found:
                return None
            at, item, share = zip(*found)
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[t] for t in at], pa.int64()), pa.array(item, pa.int64()), pa.array(share, pa.float64())],
                names=["doc_id", "item_id", "share"])

        out = out.union(map_batches(coded.where("codes is not null").select("doc_id", "codes"), kernel, schema))
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """The rows whose text leaks no item, unchanged and not shuffled."""
    scratch = Scratch(docs.sparkSession, "leaks")
    at = docs.columns.index(text_col)
    out = docs
    for items, coded in _prepare(docs, benchmark, scratch, id_col, text_col, item_col, item_text_col, answer_col):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        scratch.drop(coded)

        def kernel(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            known = shared.value.vocabulary
            keep = np.ones(batch.num_rows, bool)
            found = shared.value.matcher().find([_ids(known, t) for t in texts(batch.column(at))])
            keep[[t for t, _, _ in found]] = False
            return batch.filter(pa.array(keep))

        out = map_batches(out, kernel, docs.schema)
    return out
