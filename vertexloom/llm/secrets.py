"""Secret scans with corpus-wide ownership frequency.

Candidates are found by pattern in each whole text. Their values' hashes are
counted over the corpus by distinct owners and distinct repositories: a value
that many owners hold is a copied example, one that a single owner holds looks
like a live credential. Known provider formats and long mixed strings are
reported in addition to the base kinds where ownership says they are one
owner's own.

Defined cases: a null text is empty; offsets count code points, end exclusive;
a null owner or repository counts as one owner or repository named by the empty
string; rows repeat as they do in the input, each with its own spans; spans that
start together come in the order of their kinds; texts are read whole, and time
and memory grow as a text and its spans do; an empty table gives an empty
result; other columns are ignored, and masking keeps them whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from vertexloom.llm._arrow import free_names, map_batches, texts
from vertexloom.plans.scratch import Scratch

KINDS = ("assign", "access", "hex")
#: Kinds the method adds, in the order of the contract's "kind as listed" after the base ones.
ADDED = ("provider", "mixed")
#: Owners that may hold a value before it counts as a copied example.
MAX_OWNERS = 1

_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PROVIDER = re.compile(
    r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abpr]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----")
_MIXED = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_SIGNS = ("gh", "xox", "sk_live_", "AIza", "eyJ", "PRIVATE KEY-----")
_HEX_RUN = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_MIX_RUN = bytes(1 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-" else 0
                 for b in range(256))


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _is_mixed(s: str) -> bool:
    """Upper case, lower case and digits, spread like random characters rather than words or paths."""
    return (any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s)
            and s.count("/") <= 2 and _entropy(s) >= 4.2)


def find(text: str) -> list[tuple[str, int, int, str]]:
    """``(kind, start, end, value)`` by start, then kind; the added kinds never overlap another span."""
    out = []
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        out += [("assign", m.start(), m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text)]
    raw = text.encode("utf-8", "surrogatepass")
    if b"\1" * 24 in raw.translate(_HEX_RUN):
        out += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    more = []
    if any(s in text for s in _SIGNS):
        more += [("provider", m.start(), m.end(), m[0]) for m in _PROVIDER.finditer(text)]
    if b"\1" * 32 in raw.translate(_MIX_RUN):
        more += [("mixed", m.start(), m.end(), m[0]) for m in _MIXED.finditer(text) if _is_mixed(m[0])]
    if more:
        starts, ends = [], []  # what is taken, as disjoint ranges in order
        for start, end in sorted((x[1], x[2]) for x in out):
            if ends and start < ends[-1]:
                ends[-1] = max(ends[-1], end)
            else:
                starts.append(start)
                ends.append(end)
        for x in more:
            i = bisect_right(ends, x[1])
            if i == len(starts) or starts[i] >= x[2]:
                out.append(x)
                starts.insert(i, x[1])
                ends.insert(i, x[2])
    order = KINDS + ADDED
    return sorted(out, key=lambda x: (x[1], order.index(x[0]), x[2]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64())])
_FOUND = "array<struct<kind:string,start:int,end:int,value:long>>"
_SCAN = ("doc_id long, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, "
         f"found {_FOUND}")


def _as_rows(spans) -> list[dict]:
    """Spans with the hash of their values in place of the values."""
    return [{"kind": k, "start": s, "end": e,
             "value": xxhash.xxh64_intdigest(v.encode("utf-8", "surrogatepass")) - (1 << 63)} for k, s, e, v in spans]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo=None, owner=None) -> DataFrame:
    """Candidates of each row with their values' 64-bit hashes, and the digest of the base spans."""
    picked = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
        F.coalesce(repo if repo is not None else F.lit(""), F.lit("")).alias("repo"),
        F.coalesce(owner if owner is not None else F.lit(""), F.lit("")).alias("owner"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, sha, found = {k: [] for k in KINDS}, [], []
        for t in texts(batch.column(1)):
            spans = find(t)
            base = [x[:3] for x in spans if x[0] in KINDS]
            for k in KINDS:
                counts[k].append(sum(x[0] == k for x in base))
            sha.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            found.append(_as_rows(spans))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), batch.column(3), *(pa.array(counts[k], pa.int64()) for k in KINDS),
             pa.array(sha, pa.string()), pa.array(found, pa.list_(_SPAN))],
            names=["doc_id", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    return map_batches(picked, kernel, _SCAN)


def ownership(scanned: DataFrame) -> DataFrame:
    """``(value, repos, owners)``: in how many distinct repositories and owners each candidate value occurs.

    Pairs are made distinct before they are counted, so a value that a third
    of all rows hold is combined within each task.
    """
    places = scanned.select("repo", "owner", F.explode("found.value").alias("value")).distinct()
    by_owner = places.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("value").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo=None, owner=None,
                 max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row per input row with its spans and what ownership says of them.

    ``found`` holds the spans with ``owners``, ``repos`` and ``live``: held by at
    most ``max_owners`` owners. ``spans`` joins all base spans and those added
    spans that are live.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    scanned = scratch.save(scan(docs, id_col, text_col, repo, owner).withColumn(
        "row", F.monotonically_increasing_id()), "scan")
    some = scanned.where(F.size("found") > 0)
    each = some.select("row", F.explode("found").alias("x")).select("row", "x.*")
    known = each.join(ownership(some), "value").groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        "start", F.array_position(F.array(*map(F.lit, KINDS + ADDED)), F.col("kind")).alias("order"), "end", "kind",
        "owners", "repos", (F.col("owners") <= max_owners).alias("live")))).alias("known"))
    shown = F.filter("known", lambda x: x["kind"].isin(*KINDS) | x["live"])
    return scanned.drop("found").join(known, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(F.array_join(F.transform(shown, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","),
                   F.lit("")).alias("spans"),
        F.coalesce(F.size(F.filter("known", lambda x: x["live"])), F.lit(0)).cast("long").alias("n_live"),
        F.coalesce(F.size(F.filter("known", lambda x: ~x["live"])), F.lit(0)).cast("long").alias("n_copied"),
        F.transform(shown, lambda x: F.struct(x["start"], x["end"], x["kind"], x["owners"], x["repos"],
                                              x["live"])).alias("found"))


#: What stands in a text where a live-looking secret was.
MASK = "[secret removed]"


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo=None, owner=None,
                 max_owners: int = MAX_OWNERS) -> DataFrame:
    """The documents with live-looking secrets masked; copied examples and all other text stay.

    One pass over the texts finds the candidates. Rows without any go on as they
    are; only rows that hold candidates are joined to what ownership says.
    """
    scratch = Scratch(docs.sparkSession, "mask")
    cols = docs.columns
    at = cols.index(text_col)
    n_cols = len(cols)
    counted = cols.index("n_chars") if "n_chars" in cols else -1
    c_repo, c_owner, c_found, c_row, c_live = free_names(cols, "repo", "owner", "found", "row", "live")
    keys = [F.coalesce(x if x is not None else F.lit(""), F.lit("")).alias(n)
            for n, x in ((c_repo, repo), (c_owner, owner))]

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_as_rows(find(t)) for t in texts(batch.column(at))]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(_SPAN))],
                                          names=[*batch.schema.names, c_found])

    picked = docs.select("*", *keys)
    held = map_batches(picked, look, StructType(
        [*picked.schema.fields, *StructType.fromDDL(f"{c_found} {_FOUND}").fields]))
    held = scratch.save(held.withColumn(c_row, F.monotonically_increasing_id()), "docs")
    some = held.where(F.size(c_found) > 0)
    slim = some.select(F.col(c_row).alias("row"), F.col(c_repo).alias("repo"), F.col(c_owner).alias("owner"),
                       F.col(c_found).alias("found"))
    live = slim.select("row", F.explode("found").alias("x")).select("row", "x.*").join(
        ownership(slim).where(F.col("owners") <= max_owners), "value", "left_semi").groupBy(
        F.col("row").alias(c_row)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(c_live))
    joined = some.join(live, c_row, "left").select(*cols, c_live)

    def mask(batch: pa.RecordBatch) -> pa.RecordBatch:
        arrays = [batch.column(i) for i in range(n_cols)]
        spans = batch.column(n_cols).to_pylist()
        out = [_masked(t, x) if x else t for t, x in zip(arrays[at].to_pylist(), spans)]
        arrays[at] = pa.array(out, arrays[at].type)
        if counted >= 0:
            arrays[counted] = pa.array([len(t) if x else n for t, x, n in zip(out, spans, arrays[counted].to_pylist())],
                                       arrays[counted].type)
        return pa.RecordBatch.from_arrays(arrays, names=cols)

    return held.where(F.size(c_found) == 0).select(*cols).unionAll(map_batches(joined, mask, docs.schema))


def _masked(text: str, spans: list[dict]) -> str:
    parts, done = [], 0
    for s, e in ((x["start"], x["end"]) for x in spans):
        if s >= done:
            parts += [text[done:s], MASK]
        done = max(done, e)
    return "".join([*parts, text[done:]])
