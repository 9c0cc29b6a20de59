"""Byte-level BPE encoding by forced boundaries, and decoding.

A byte pair that occurs inside no vocabulary token can never be merged over, so
it marks a certain token boundary. After the tokenizer's own pre-splitting every
piece is cut at such pairs; fragments are encoded independently by their merge
ranks and the results concatenated. Long runs without spaces thus fall into
short fragments. Fragments of one length are merged together as rows of a
matrix; a piece met before comes from a bounded memo.

Defined cases: a null text is the empty text with no tokens; special tokens in a
text become their ids, as the tokenizers library does by default; of merges that
tie in rank the leftmost comes first; a text of any length is encoded whole, in
runs of pieces that bound what is in memory beside its ids; lone
surrogates cannot occur in the UTF-8 tables; rows repeat as they do in the
input; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from vertexloom.llm._arrow import map_batches, texts

#: The pre-splitting rule of the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of one worker's memo, and the bytes of the longest piece that is kept in it.
MEMO_PIECES, MEMO_BYTES = 300_000, 64
#: Characters whose pieces are in memory together; longer texts go through in runs of PIECES pieces.
CHUNK_CHARS, PIECES = 1 << 20, 200_000
_NEVER = 1 << 30  # the rank of a pair that does not merge


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Memo(dict):
    """Piece to its ids as little-endian bytes; filled on a miss, emptied when full."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        out = self.encode(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= MEMO_BYTES:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = out
        return out


class ByteBPE:
    """A byte-level BPE tokenizer read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_symbols()
        model = spec["model"]
        self.bytes_of: dict[int, bytes] = {
            i: bytes(map(to_byte.__getitem__, token)) for token, i in model["vocab"].items()}
        id_of = {b: i for i, b in self.bytes_of.items()}
        self.byte_id = [id_of.get(bytes([b]), -1) for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right = (bytes(map(to_byte.__getitem__, x)) for x in (a, b))
            self.merges[id_of[left], id_of[right]] = rank, id_of[left + right]
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        by_key = np.argsort(keys)
        self.pair_keys = np.append(keys[by_key], np.int64(1 << 62))
        self.pair_ranks = np.append(np.array([r for r, _ in self.merges.values()], np.int64)[by_key], _NEVER)
        self.made = np.zeros(max((r for r, _ in self.merges.values()), default=0) + 1, np.int64)
        for r, new in self.merges.values():
            self.made[r] = new
        inside = np.zeros((256, 256), bool)
        for token in self.bytes_of.values():
            if len(token) > 1:
                t = np.frombuffer(token, np.uint8)
                inside[t[:-1], t[1:]] = True
        self.inside = inside
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of.update({i: s.encode() for s, i in self.special.items()})
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.cut_special = regex.compile("|".join(
            map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.split, self.split_iter = regex.compile(PATTERN).findall, regex.compile(PATTERN).finditer
        self.memo = _Memo(self._piece)

    def fragments(self, piece: bytes) -> list[bytes]:
        """The piece cut wherever two neighbouring bytes occur in no token."""
        if len(piece) < 2:
            return [piece]
        b = np.frombuffer(piece, np.uint8)
        cuts = (np.flatnonzero(~self.inside[b[:-1], b[1:]]) + 1).tolist()
        return [piece[i:j] for i, j in zip([0, *cuts], [*cuts, len(piece)])]

    def _piece(self, piece: bytes) -> bytes:
        ids = [i for fragment in self.fragments(piece) for i in self._merge(fragment)]
        return np.array(ids, "<u4").tobytes()

    def _merge(self, fragment: bytes) -> list[int]:
        ids = [i for i in map(self.byte_id.__getitem__, fragment) if i >= 0]
        if len(ids) > 48:
            return self._merge_long(ids)
        get = self.merges.get
        while len(ids) > 1:
            found = [(x, i) for i, pair in enumerate(zip(ids, ids[1:])) if (x := get(pair)) is not None]
            if not found:
                break
            (_, new), at = min(found)
            ids[at:at + 2] = [new]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges with a heap over a linked list, for runs that no boundary cuts."""
        n, get = len(ids), self.merges.get
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(x[0], i, ids[i], ids[i + 1], x[1]) for i in range(n - 1) if (x := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            nxt[i] = nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            for left, right in ((prv[i], i), (i, nxt[i])):
                if left >= 0 and right >= 0 and (x := get((ids[left], ids[right]))):
                    heapq.heappush(heap, (x[0], left, ids[left], ids[right], x[1]))
        return [x for x in ids if x >= 0]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NEVER)

    def _merge_rows(self, ids: np.ndarray):
        """``(rows, ids)`` of fragments of one length, as they finish: every round merges each row's first pair of least rank."""
        rows = np.arange(len(ids))
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), _NEVER)
            go = best < _NEVER
            if not go.all():
                yield rows[~go], ids[~go]
                rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
                if not len(rows):
                    return
            every, col = np.arange(len(rows)), np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, col + (col > at[:, None]), 1)
            ids[every, at] = self.made[best]
            col = col[:-1]
            ranks = np.take_along_axis(ranks, col + (col >= at[:, None]), 1)
            if len(col):
                left = np.flatnonzero(at > 0)
                ranks[left, at[left] - 1] = self._ranks(ids[left, at[left] - 1], ids[left, at[left]])
                right = np.flatnonzero(at < len(col))
                ranks[right, at[right]] = self._ranks(ids[right, at[right]], ids[right, at[right] + 1])

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Each piece's ids as bytes; the fragments of all pieces are merged together."""
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        cut = np.ones(len(raw), bool)  # a fragment starts here
        cut[1:] = ~self.inside[raw[:-1], raw[1:]]
        cut[ends[:-1]] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, len(raw)))
        first = np.array(self.byte_id, np.int64)[raw]
        done, count = [], np.ones(len(start), np.int64)
        for n in np.unique(size).tolist():
            of = np.flatnonzero(size == n)
            for a in range(0, len(of), 1 << 16):
                part = of[a:a + (1 << 16)]
                for rows, ids in self._merge_rows(first[start[part][:, None] + np.arange(n)]):
                    done.append((part[rows], ids))
                    count[part[rows]] = ids.shape[1]
        place = np.append(0, np.cumsum(count))
        out = np.zeros(place[-1], "<u4")
        for rows, ids in done:
            out[place[rows][:, None] + np.arange(ids.shape[1])] = ids
        bound = (4 * place[np.searchsorted(start, np.append(0, ends))]).tolist()
        joined = out.tobytes()
        return [joined[i:j] for i, j in zip(bound, bound[1:])]

    def _learn(self, pieces: Iterable[str]) -> None:
        """Put the pieces that the memo lacks into it; long ones are left to be merged when met."""
        if min(self.byte_id) < 0:
            return
        met = set(pieces)
        new = [p for p in met if p not in self.memo]
        if len(self.memo) + len(new) > MEMO_PIECES:
            self.memo.clear()
            new = list(met)
        raw = [(p, p.encode("utf-8", "surrogatepass")) for p in new]
        raw = [x for x in raw if len(x[1]) <= MEMO_BYTES]
        if raw:
            self.memo.update(zip((p for p, _ in raw), self._encode_pieces([b for _, b in raw])))

    def _run(self, text: str) -> Iterable[bytes]:
        """Ids of a text without special tokens, piece by piece."""
        if len(text) <= CHUNK_CHARS:
            pieces = self.split(text)
            self._learn(pieces)
            yield from map(self.memo.__getitem__, pieces)
            return
        found = (m[0] for m in self.split_iter(text))
        while pieces := list(islice(found, PIECES)):
            self._learn(pieces)
            yield b"".join(map(self.memo.__getitem__, pieces))

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.cut_special is None or not self.cut_special.search(text):
            return b"".join(self._run(text))
        out, at = [], 0
        for m in self.cut_special.finditer(text):
            out.extend(self._run(text[at:m.start()]))
            out.append(self.special[m[0]].to_bytes(4, "little"))
            at = m.end()
        out.extend(self._run(text[at:]))
        return b"".join(out)

    def encode_many(self, rows: list[str]) -> Iterable[bytes]:
        """The ids of each text in turn; the new pieces of texts that lie together are merged together."""
        held, chars = [], 0

        def flush() -> Iterable[bytes]:
            cut = [self.split(t) for t in held]
            self._learn(chain.from_iterable(cut))
            memo = self.memo.__getitem__
            for pieces in cut:
                yield b"".join(map(memo, pieces))

        for t in rows:
            plain = len(t) <= CHUNK_CHARS and (self.cut_special is None or not self.cut_special.search(t))
            if held and (not plain or chars + len(t) > CHUNK_CHARS):
                yield from flush()
                held, chars = [], 0
            if plain:
                held.append(t)
                chars += len(t)
            else:
                yield self.encode_bytes(t)
        if held:
            yield from flush()

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids) -> str:
        """The text of ids; broken UTF-8 becomes replacement characters, unknown ids nothing."""
        table, n = self.table, len(self.table)
        try:
            joined = b"".join(map(table.__getitem__, ids))
        except IndexError:
            joined = b"".join(table[i] for i in ids if i < n)
        return joined.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBPE:
    """One tokenizer per file and Python worker."""
    return ByteBPE(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` for every row."""
    path = path or default_path()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tokenizer(path)
        rows = [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode_many(texts(batch.column(1)))]
        offsets = np.r_[0, np.cumsum([len(x) for x in rows])].astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows)))
        return pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                       kernel, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``."""
    path = path or default_path()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tokenizer(path)
        out = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), kernel, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids, and give digests of both.

    ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``; both directions run in
    one pass, so neither ids nor texts are shuffled.
    """
    path = path or default_path()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tokenizer(path)
        n, ids_sha, text_sha = [], [], []
        for raw in bpe.encode_many(texts(batch.column(1))):
            n.append(len(raw) // 4)
            ids_sha.append(hashlib.sha256(raw).hexdigest())
            back = bpe.decode(np.frombuffer(raw, "<u4").tolist())
            text_sha.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                       kernel, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
