"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from its bytes (byte
and byte-pair-class frequencies, word and repetition measures), mapped to a
small representation and weighted by gated attention; the weighted sum is
scored. Attention and scorer are learned together from document labels alone
(Ilse, Tomczak and Welling 2018), on a bounded sample of labelled documents.

Defined cases: a null or empty text is one empty passage and gets a score like
any other; texts are scored whole, all passages of one text together; labels
that are null or name no document are not used, of contradicting labels of a
document the larger counts, and of different texts under one id training reads
that with the smallest hash; a score at the threshold counts as label 1; without
labels of both classes every score is their mean, or 0.5 without any; repeated
rows get equal scores; an empty table gives an empty result; other columns are
never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vertexloom.llm._arrow import map_batches, texts
from vertexloom.plans.scratch import Scratch

#: Labelled documents that training reads at most: those with the smallest hashes of their ids.
SAMPLE_ROWS = 4000
#: Passages of those documents together. Each is read with all of its passages, and only as many documents, in the order
#: of their hashes, as stay within this; the first one always counts.
SAMPLE_PASSAGES = 200_000
#: Bytes of a passage; the last one of a document may be shorter.
PASSAGE_BYTES = 2048
THRESHOLD = 0.3
HIDDEN, GATE, EPOCHS, BATCH = 24, 12, 30, 64
#: Passages whose gradients are computed together; a batch with more adds them up piece by piece.
PIECE = 8192

_CLASS = np.zeros(256, np.int64)
for _chars, _c in ((b" ", 1), (b"\n\r\t\x0b\x0c", 2), (b"0123456789", 3), (b".,;:", 4), (b"!?", 5), (b"'\"()-", 6)):
    _CLASS[list(_chars)] = _c
_CLASS[97:123], _CLASS[65:91], _CLASS[128:] = 7, 8, 9
_CLASS[list(b"#$%&*|<>=+@^~_\\/[]{}")] = 10
_CLASSES = 11
#: Buckets of word hashes per passage, for how often words repeat.
_BUCKETS = 512
FEATURES = 128 + _CLASSES + _CLASSES * _CLASSES + 8


def encode_passages(text: str) -> np.ndarray:
    """One row of features per passage of the whole text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    m = max(1, -(-n // PASSAGE_BYTES))
    out = np.zeros((m, FEATURES), np.float32)
    if n:
        passage = np.arange(n) // PASSAGE_BYTES
        size = np.bincount(passage, minlength=m).astype(np.float32)[:, None]
        cls = _CLASS[raw]
        low = np.bincount(passage * 256 + raw, minlength=m * 256).reshape(m, 256)
        out[:, :128] = np.sqrt(low[:, :128] / size)
        by_class = np.bincount(passage * _CLASSES + cls, minlength=m * _CLASSES).reshape(m, _CLASSES)
        at = 128
        out[:, at:at + _CLASSES] = by_class / size
        at += _CLASSES
        if n > 1:
            pair = np.bincount(passage[1:] * _CLASSES**2 + cls[:-1] * _CLASSES + cls[1:],
                               minlength=m * _CLASSES**2).reshape(m, -1)
            out[:, at:at + _CLASSES**2] = np.sqrt(pair / size)
        at += _CLASSES**2
        space = (cls == 1) | (cls == 2)
        first = ~space & np.r_[True, space[:-1]]
        starts = np.flatnonzero(first)
        words = np.bincount(passage[starts], minlength=m).astype(np.float32)
        # a word's hash: the sum of its bytes times growing odd numbers, by differences of a running sum
        run = np.r_[0, np.cumsum((raw.astype(np.int64) + 1) * ~space)]
        weighted = np.r_[0, np.cumsum((raw.astype(np.int64) + 1) * np.arange(n) * (~space))]
        if len(starts):
            ends = np.r_[starts[1:], n]
            total = run[ends] - run[starts]
            moment = weighted[ends] - weighted[starts] - starts * total
            code = (total * 2654435761 + moment * 40503) >> 3
            slot = np.bincount(passage[starts] * _BUCKETS + code % _BUCKETS, minlength=m * _BUCKETS).reshape(m, _BUCKETS)
            many = np.maximum(words, 1)
            out[:, at] = (slot > 0).sum(1) / np.minimum(many, _BUCKETS)
            out[:, at + 1] = slot.max(1) / many
            out[:, at + 2] = np.sqrt((slot.astype(np.float32)**2).sum(1)) / many
            whole = np.bincount(code % 65536)
            out[:, at + 3] = (whole > 0).sum() / min(len(starts), 65536)
            out[:, at + 4] = whole.max() / len(starts)
        lines = text.split("\n")
        out[:, at + 5] = len(set(lines)) / len(lines)
        out[:, at + 6] = np.log1p(words) / 6
        out[:, at + 7] = np.log1p(n) / 12
    return out


@dataclass
class Model:
    """Standardised features, a tanh layer, gated attention and a logistic scorer."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray] | None
    prior: float

    def _parts(self, x: np.ndarray, bag: np.ndarray, n: int):
        w = self.w
        h = np.tanh(x @ w["W"] + w["b"])
        v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (v * u) @ w["a"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, bag, e)
        e = np.exp(e - top[bag])
        attention = e / np.bincount(bag, e, n)[bag]
        z = np.stack([np.bincount(bag, attention * h[:, j], n) for j in range(h.shape[1])], 1)
        score = 1 / (1 + np.exp(-(z @ w["c"] + w["d"])))
        return h, v, u, attention, z, score

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.w is None or not bags:
            return np.full(len(bags), self.prior)
        bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        x = (np.concatenate(bags).astype(np.float64) - self.mean) / self.scale
        return self._parts(np.clip(x, -6, 6), bag, len(bags))[-1]


def _gradients(model: Model, bags: list[np.ndarray], labels: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Gradients of these bags' share in the mean cross-entropy of ``n`` bags."""
    w = model.w
    x = np.clip((np.concatenate(bags) - model.mean) / model.scale, -6, 6)
    bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    h, v, u, att, z, score = model._parts(x, bag, len(bags))
    err = (score - labels) / n
    g = {"c": z.T @ err, "d": err.sum()}
    dz = err[:, None] * w["c"]
    datt = (dz[bag] * h).sum(1)
    de = att * (datt - np.bincount(bag, att * datt, len(bags))[bag])
    dvu = de[:, None] * w["a"]
    g["a"] = (v * u).T @ de
    dv, du = dvu * u * (1 - v * v), dvu * v * u * (1 - u)
    g["V"], g["U"] = h.T @ dv, h.T @ du
    dh = (att[:, None] * dz[bag] + dv @ w["V"].T + du @ w["U"].T) * (1 - h * h)
    g["W"], g["b"] = x.T @ dh, dh.sum(0)
    return g


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Learn attention and scorer by Adam on the cross-entropy of whole documents."""
    prior = float(np.mean(labels)) if len(labels) else 0.5
    if len(labels) == 0 or len(set(labels.tolist())) < 2:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), None, prior)
    rng = np.random.default_rng(seed)
    n = sum(map(len, bags))
    mean = sum(b.sum(0, dtype=np.float64) for b in bags) / n
    spread = sum((np.square(b - mean)).sum(0) for b in bags) / n
    scale = np.sqrt(spread) + 0.02
    d = FEATURES
    w = {"W": rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), "b": np.zeros(HIDDEN),
         "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)),
         "a": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(())}
    model = Model(mean, scale, w, prior)
    m1, m2 = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for s in range(0, len(order), BATCH):
            pick = order[s:s + BATCH]
            g: dict = dict.fromkeys(w, 0.0)
            for piece in np.split(pick, np.flatnonzero(np.diff(np.cumsum([len(bags[i]) for i in pick]) // PIECE)) + 1):
                for k, x in _gradients(model, [bags[i] for i in piece], labels[piece], len(pick)).items():
                    g[k] = g[k] + x
            step += 1
            rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
            for k in w:
                grad = g[k] + (1e-3 * w[k] if k in ("W", "c") else 0)
                m1[k] = 0.9 * m1[k] + 0.1 * grad
                m2[k] = 0.999 * m2[k] + 0.001 * grad * grad
                w[k] = w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
            model.w = w
    return model


def fold(id_col: Column) -> Column:
    """``crc32`` of the id as text, modulo five; fold 0 is held out from learning."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5, F.lit(1))


def within(sizes: list[int], most: int) -> int:
    """How many of the first bags of these sizes stay within ``most`` passages; one at least."""
    return max(1, int(np.searchsorted(np.cumsum(sizes), most, "right")))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS,
          id_col: str = "doc_id", text_col: str = "text", sample_passages: int = SAMPLE_PASSAGES) -> Model:
    """A model from the labelled rows outside the held-out fold.

    At most ``sample_rows`` documents are read, those with the smallest hashes
    of their ids, each with all of its passages, and fewer where they have more
    than ``sample_passages`` together; so what is gathered is bounded.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).where(
        "id is not null and y is not null").where(fold(F.col("id")) != 0).groupBy("id").agg(F.max("y").alias("y"))
    # only as many ids as the sample can use are ever ordered, however many labels there are
    share = min(1.0, 4 * sample_rows / max(known.count(), 1))
    mark = F.xxhash64("id", F.lit(11))
    picked = known.withColumn("mark", mark).where(F.col("mark") < F.lit(int(-(1 << 63) + share * ((1 << 64) - 2048)))).orderBy(
        "mark", "id").limit(sample_rows)
    joined = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(picked), "id").select("id", "y", "mark", F.xxhash64("text").alias("by"), "text")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        bags = [encode_passages(t).astype(np.float16) for t in texts(batch.column(4))]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(map(len, bags), pa.int64()), pa.array([b.tobytes() for b in bags], pa.binary())],
            names=["id", "y", "mark", "by", "n", "bag"])

    rows = map_batches(joined, kernel, "id long, y double, mark long, by long, n long, bag binary").groupBy(
        "id", "y", "mark").agg(F.min(F.struct("by", "n", "bag")).alias("x"))
    rows = Scratch(docs.sparkSession, "quality").save(rows.select("id", "y", "mark", "x.n", "x.bag"), "bags")
    sizes = sorted(tuple(r) for r in rows.select("mark", "id", "n").collect())
    if not sizes:
        return fit([], np.zeros(0))
    last, last_id, _ = sizes[within([n for *_, n in sizes], sample_passages) - 1]
    taken = rows.where((F.col("mark") < last) | ((F.col("mark") == last) & (F.col("id") <= last_id))).collect()
    taken.sort(key=lambda r: r.id)
    return fit([np.frombuffer(r.bag, np.float16).reshape(-1, FEATURES) for r in taken], np.array([r.y for r in taken], float))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
            threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        score = []
        rows = texts(batch.column(1))
        for a in range(0, len(rows), 64):
            score += model.score([encode_passages(t) for t in rows[a:a + 64]]).tolist()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    scored = map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                         kernel, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text the model does not reject, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = texts(batch.column(at))
        score = np.concatenate([shared.value.score([encode_passages(t) for t in rows[a:a + 64]])
                                for a in range(0, len(rows), 64)])
        return batch.filter(pa.array(score >= threshold))

    return map_batches(docs, kernel, docs.schema)
