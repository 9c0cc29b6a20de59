"""WARC archives: writing with revisit records, and a salvage reader.

Each record is one gzip member, so a damaged archive loses only what is
damaged. The reader checks every member (gzip checksum, record header, declared
length, closing line, block and payload digests). Where a check fails it
searches for the next position at which a whole member or a version line reads
well, goes on from there and reports the bytes between as a quarantined gap. A
foreign member may hold several records: those that read well are recovered
whatever lies between them, and of a member whose own checksum fails, or that is
cut off, those that a digest vouches for.

Which payloads are revisits is decided on digests alone. Archives are written
and read by Spark's own file sources, so they may lie in any store Spark knows,
and a lost task is written again by another executor. Archives written here stay
near ``ARCHIVE_CHUNKS`` times a few megabytes; the reader takes a file whole, so
foreign archives must fit a task's memory.

Defined cases: a null payload is empty; of equal payloads with at least
``min_bytes`` bytes the largest id is the response and the others revisit it;
repeated rows of the largest id are responses all, and a row without an id is a
response unless another row with an id has its payload, which it then revisits;
null urls are written as an empty target; a record of any length is written and
read whole; an empty table writes no records; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from vertexloom.llm._arrow import find_package, map_batches
from vertexloom.plans.scratch import Scratch

MIN_BYTES = 1000
#: Slices of rows, each of a few megabytes of payload, that one archive file holds.
ARCHIVE_CHUNKS = 8
#: Digests of payloads that occur twice or more are broadcast up to this many; more are joined by a shuffle.
BROADCAST_DIGESTS = 200_000
#: Inflated bytes after which a gzip member counts as damaged, and the bytes in which a record's header must end.
MEMBER_BYTES, HEADER_BYTES = 1 << 30, 1 << 16
_VERSION = b"WARC/1."
_GZIP = b"\x1f\x8b\x08"
_END = b"\r\n\r\n"
#: An empty member ends in a zero byte; it follows records whose own last byte is not zero.
_EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff0300") + bytes(8)


def _uri(url: str) -> str:
    return quote(url, safe=":/?#[]@!$&'()*+,;=%~")


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def build_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None,
                 date: str = "2000-01-01T00:00:00Z") -> bytes:
    """One uncompressed record; a revisit keeps the HTTP header only and names its response."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
            + str(len(payload)).encode() + _END)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    of_block = base64.b32encode(hashlib.sha1(block).digest()).decode()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{b32}",
        f"WARC-Block-Digest: sha1:{of_block}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
        f"Page-Id: {'' if page_id is None else page_id}", f"Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"Refers-To-Page: {refers_to}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + _END + block + _END


def member(record: bytes, level: int = 6) -> bytes:
    """The record as a gzip member."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          min_bytes: int = MIN_BYTES) -> None:
    """Write one record per row into gzip-member archives under ``path``.

    Only digests are grouped. The few that occur twice or more tell which rows
    are revisits; payloads move only where those digests are too many to
    broadcast, and then a payload that many rows share is split by adaptive
    execution, and rows too short to be shared go anywhere.
    """
    spark = pages.sparkSession
    raw = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b""))
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(url_col, F.lit("")).alias("url"),
                       raw.alias("payload"))
    src = src.withColumn("digest", F.sha1("payload"))
    long_enough = F.octet_length("payload") >= min_bytes
    shared = Scratch(spark, "warc").save(src.where(long_enough).groupBy("digest").agg(
        F.count("*").alias("n"), F.max("page_id").alias("first")).where("n > 1 and first is not null").select(
        F.col("digest").alias("key"), "first"), "shared")
    few = shared.count() <= BROADCAST_DIGESTS
    alone = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))
    marked = src.withColumn("key", F.when(long_enough, F.col("digest")).otherwise(alone)).join(
        F.broadcast(shared) if few else shared, "key", "left")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for page_id, url, payload, digest, first in zip(*(batch.column(i).to_pylist() for i in range(5))):
            refers = first if first is not None and first != page_id else None
            out.append(member(build_record(page_id, url, payload, digest, refers)))
        if out[-1][-1]:
            out.append(_EMPTY_MEMBER)
        return pa.RecordBatch.from_arrays([pa.array([b"".join(out)[:-1]], pa.binary())], names=["value"])

    chunks = map_batches(marked.select("page_id", "url", "payload", "digest", "first"), kernel, "value binary")
    # the text sink writes a string's bytes as they are; every chunk's last byte is the zero that it adds as separator
    chunks.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option(
        "maxRecordsPerFile", ARCHIVE_CHUNKS).text(path)


def _inflate(data: bytes, at: int) -> tuple[bytes, int | None]:
    """The content of the gzip member at ``at`` and where it ends; what came out and None where it fails its check."""
    d = zlib.decompressobj(31)
    view, parts, pos, step, size = memoryview(data), [], at, 1 << 14, 0
    try:
        while pos < len(data) and not d.eof and size <= MEMBER_BYTES:
            parts.append(d.decompress(view[pos:pos + step]))
            size += len(parts[-1])
            pos += step
    except zlib.error:
        return b"".join(parts), None
    if not d.eof:
        return b"".join(parts), None
    return b"".join(parts), min(pos, len(data)) - len(d.unused_data)


def parse_record(data: bytes, at: int = 0) -> tuple[dict, bytes, int] | str:
    """Headers, block and end of the record at ``at``, or why it fails."""
    if data[at:at + len(_VERSION)] != _VERSION:
        return "no version line"
    head_end = data.find(_END, at, at + HEADER_BYTES)
    if head_end < 0:
        return "header has no end"
    headers = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header line"
        headers[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    try:
        length = int(headers["content-length"])
    except (KeyError, ValueError):
        return "no length"
    start = head_end + len(_END)
    stop = start + length
    if length < 0 or stop > len(data):
        return "block is cut off"
    if data[stop:stop + 4] != _END:
        return "record has no end"
    block = data[start:stop]
    for kind, whole in (("block", True), ("payload", headers.get("warc-type") == "response")):
        wanted = headers.get(f"warc-{kind}-digest", "")
        if whole and wanted.startswith("sha1:"):
            if base64.b32encode(hashlib.sha1(block if kind == "block" else _payload(block)).digest()).decode() != wanted[5:]:
                return f"{kind} digest differs"
            headers["checked"] = kind
    return headers, block, stop + 4


def _payload(block: bytes) -> bytes:
    return block.partition(_END)[2] if block.startswith(b"HTTP/") else block


def _records(inner: bytes, sure: bool) -> Iterator[tuple[tuple | None, str]]:
    """``(record, "")`` and ``(None, reason)`` of an inflated member, in order.

    After a record that fails, the next version line at which one reads well is
    searched for. Where the member is not ``sure``, only records with a digest
    that fits are taken.
    """
    pos, failed = 0, False
    while 0 <= pos < len(inner):
        rec = parse_record(inner, pos)
        if not isinstance(rec, str) and not sure and "checked" not in rec[0]:
            rec = "nothing vouches for the record"
        if isinstance(rec, str):
            if not failed:
                yield None, f"{rec}, at byte {pos} of the inflated member"
            failed, pos = True, inner.find(_VERSION, pos + 1)
        else:
            yield (rec[0], rec[1]), ""
            failed, pos = False, rec[2]


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """``("record", start, end, (headers, block))`` and ``("gap", start, end, reason)`` in order of position.

    Records and gaps inside a member carry the member's range. A member that
    fails its check is part of a gap, after the records recovered from it.
    """
    at, gap, why = 0, None, ""
    n = len(data)
    ahead = {_GZIP: -1, _VERSION: -1}  # where each mark comes next; looked for again only once passed
    while at < n:
        end, reason = None, "neither member nor version line"
        if data.startswith(_GZIP, at):
            inner, end = _inflate(data, at)
            reason = "gzip member fails its check"
            found = list(_records(inner, end is not None))
            if end is None:
                found = [x for x in found if x[0]]
                for rec, _ in found:
                    if gap is not None:
                        yield "gap", gap, at, why
                        gap = None
                    yield "record", at, at, rec
                if found:
                    reason += f"; {len(found)} records recovered"
        elif data.startswith(_VERSION, at):
            rec = parse_record(data, at)
            if isinstance(rec, str):
                reason = rec
            else:
                found, end = [((rec[0], rec[1]), "")], rec[2]
        if end is not None:
            if gap is not None:
                yield "gap", gap, at, why
                gap = None
            for rec, reason in found:
                yield ("record", at, end, rec) if rec else ("gap", at, end, reason)
            at = end
            continue
        if gap is None:
            gap, why = at, reason
        for mark, place in ahead.items():
            if place <= at:
                found_at = data.find(mark, at + 1)
                ahead[mark] = found_at if found_at >= 0 else n
        at = min(ahead.values())
    if gap is not None:
        yield "gap", gap, n, why


_READ = ("path string, start long, stop long, page_id long, url string, record_type string, payload_bytes long, "
         "payload_digest string, refers_to long, payload binary, gap string")


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives under ``path``; a quarantined range is a row with ``gap`` set.

    A task holds one file at a time, read whole.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    find_package(spark)
    names = [x.split()[0] for x in _READ.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(),
             pa.int64(), pa.binary(), pa.string()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                rows, size, name = [], 0, name.as_py()
                for kind, start, end, what in salvage(data.as_py()):
                    if kind == "gap":
                        rows.append((name, start, end, *[None] * 7, what))
                    else:
                        h, block = what
                        response = h.get("warc-type") == "response"
                        payload = _payload(block)
                        digest = hashlib.sha1(payload).hexdigest() if response else base64.b32decode(
                            h.get("warc-payload-digest", "sha1:")[5:]).hex()
                        number = lambda k: int(h[k]) if re.fullmatch(r"-?\d+", h.get(k, "")) else None
                        rows.append((name, start, end, number("page-id"), h.get("warc-target-uri"), h.get("warc-type"),
                                     len(payload) if response else number("payload-length"), digest,
                                     number("refers-to-page"), payload if payloads and response else None, None))
                        size += len(payload) if payloads else 0
                    if len(rows) >= 2000 or size > 8 << 20:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    return files.mapInArrow(run, _READ)
