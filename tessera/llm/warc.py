"""WARC archives: a writer of one gzip member per record, and a salvage reader (operator 2).

The writer leaves file handling to Spark's text sink, so it works on any file system and survives lost tasks: a row is
the gzip members of a file, and the line separator is an empty gzip member, so a whole file is valid gzip.

The reader checks every record (gzip checksum, version line, length, block digest). After a failed check it searches
for the next gzip magic or version line from which a record passes, and logs the bytes between as quarantined."""

from __future__ import annotations

import base64
import gzip
import hashlib
import logging
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, remove, shared_path, tune

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
#: Bytes of a file at which it takes no more records: a file is read as a whole, so this bounds a reader's memory.
FILE_BYTES = 16 << 20
#: Bytes handed to the decompressor at once.
SLICE = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Record(NamedTuple):
    offset: int
    length: int
    headers: dict[str, str]
    payload: bytes


class Gap(NamedTuple):
    offset: int
    length: int
    reason: str


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """The plain bytes of a response, or of a revisit if refers_to is given."""
    block = HTTP + (payload if refers_to is None else b"")
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {uri}"] * bool(uri)
    head += [] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parse(data: bytes, at: int, whole: bool) -> tuple[int, dict[str, str], bytes]:
    """(end, headers, payload) of the plain record at `at`; ValueError says which check failed."""
    stop = data.find(b"\r\n\r\n", at)
    if not NEXT.match(data, at) or stop < 0:
        raise ValueError("no record header")
    try:
        lines = data[at:stop].decode().split("\r\n")[1:]
        headers = dict(x.split(": ", 1) for x in lines)
        size = int(headers["Content-Length"])
    except (UnicodeDecodeError, ValueError, KeyError):
        raise ValueError("bad header") from None
    end = stop + 4 + size + 4
    block = data[stop + 4 : end - 4]
    if size < 0 or data[end - 4 : end] != b"\r\n\r\n" or whole and end != len(data):
        raise ValueError("wrong length")
    want = headers.get("WARC-Block-Digest")
    if want and want != f"sha1:{digest(block)}":
        raise ValueError("wrong digest")
    cut_at = block.find(b"\r\n\r\n")
    payload = block[cut_at + 4 :] if block.startswith(b"HTTP/") and cut_at >= 0 else block
    return end, headers, payload


def _member(data: bytes, at: int) -> tuple[int, bytes]:
    """(end, content) of the gzip member at `at`, read in slices, so that what follows it is not copied each time."""
    z, out, view = zlib.decompressobj(31), [], memoryview(data)
    try:
        while not z.eof and at < len(data):
            out.append(z.decompress(view[at : at + SLICE]))
            at += SLICE
    except zlib.error as e:
        raise ValueError("bad gzip member") from e
    if not z.eof:
        raise ValueError("short gzip member")
    return min(at, len(data)) - len(z.unused_data), b"".join(out)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records that pass all checks, and the gaps between them, in file order. Gaps and records cover all but blank bytes."""
    at, lost, why = 0, None, ""
    while at < len(data):
        try:
            if data[at : at + 2] == b"\x1f\x8b":
                end, plain = _member(data, at)
                found = _parse(plain, 0, True)[1:] if plain else None
            elif data[at : at + 5] == b"WARC/":
                end, *found = _parse(data, at, False)
            elif data[at] in b"\r\n" and lost is None:
                at += 1
                continue
            else:
                raise ValueError("no record here")
        except ValueError as e:
            if lost is None:
                lost, why = at, str(e)
            m = NEXT.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if found is not None or lost is None:
            if lost is not None:
                yield Gap(lost, at - lost, why)
                lost = None
            if found is not None:
                yield Record(at, end - at, *found)
        elif lost is not None:  # an empty member ends a gap as well
            yield Gap(lost, at - lost, why)
            lost = None
        at = end
    if lost is not None:
        yield Gap(lost, len(data) - lost, why)


def page_of(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(m[1]) if m else None


def revisits(pages: DataFrame, least: int, salts: int = 16) -> DataFrame:
    """page_id, sha, refers_to of the rows whose payload another row of a smaller page_id has; no payload is shuffled."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    small = cut(pages.select("page_id", F.sha1(payload).alias("sha"), F.length(payload).alias("bytes")), "digests").filter(F.col("bytes") >= least)
    heads = small.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1 AND refers_to IS NOT NULL").drop("copies")
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = small.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).join(heads, ["sha", "salt"])
    return rows.filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes one record per row of pages (page_id, url, html) to files under path.

    Of rows with equal payloads of at least `least` bytes, that of the smallest page_id is the response and the others
    revisit it; rows that share page_id and payload are all what one of them is. A null html is an empty payload; a null
    page_id counts as larger than any. Extra columns are ignored. An empty table writes no record."""
    tune(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    again = revisits(pages, least).select(F.coalesce("page_id", F.lit(-1)).alias("_id"), F.col("page_id").isNull().alias("_none"), F.col("sha").alias("_sha"), "refers_to")

    def pack(batches):
        # both forms of a record: which one it is, is known after the join
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for page, url, html in zip(ids, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                payload = (html or "").encode()
                out.append((page, url, hashlib.sha1(payload).hexdigest(), len(payload), gzip.compress(record(page, url, payload), 6, mtime=0)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["page_id", "url", "sha", "bytes", "member"])

    def choose(batches):
        # a row is a whole file: members up to FILE_BYTES, or one larger member
        held, size_held = [], 0
        for batch in batches:
            for page, url, sha, size, member, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first is not None:
                    member = gzip.compress(_revisit(page, url, sha, size, first), 6, mtime=0)
                if held and size_held + len(member) > FILE_BYTES:
                    yield _file(held)
                    held, size_held = [], 0
                held.append(member)
                size_held += len(member)
        if held:
            yield _file(held)

    packed = pages.mapInArrow(pack, "page_id long, url string, sha string, bytes long, member binary")
    on = (F.coalesce("page_id", F.lit(-1)) == F.col("_id")) & (F.col("page_id").isNull() == F.col("_none")) & (F.col("sha") == F.col("_sha"))
    rows = packed.join(again, on, "left").select("page_id", "url", "sha", "bytes", "member", "refers_to").mapInArrow(choose, "member binary")
    sink = rows.select(F.col("member").cast("string").alias("value")).write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1")
    sink.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _file(members: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["member"])


def _revisit(page, url, sha: str, size: int, first: int) -> bytes:
    plain = record(page, url, b"", first)
    full = base64.b32encode(bytes.fromhex(sha)).decode()
    plain = re.sub(rb"WARC-Payload-Digest: sha1:\w+", f"WARC-Payload-Digest: sha1:{full}".encode(), plain, count=1)
    return plain.replace(b"X-Payload-Length: 0", f"X-Payload-Length: {size}".encode(), 1)


FOUND = "file string, offset long, length long, reason string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record (reason null) and per quarantined gap (reason set, no record columns) of the files under path.

    Of responses, payload_bytes and payload_digest are computed from the bytes read; of revisits, they are what the
    record says of the full payload, and payload is null."""
    tune(spark)

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = []
                for x in salvage(data):
                    if isinstance(x, Gap):
                        out.append((file, x.offset, x.length, x.reason, *[None] * 7))
                    else:
                        h = x.headers
                        kind, full = h.get("WARC-Type"), h.get("WARC-Type") != "revisit"
                        size = len(x.payload) if full else int(h.get("X-Payload-Length", 0))
                        sha = digest(x.payload) if full else h.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                        out.append((file, x.offset, x.length, None, page_of(h.get("WARC-Record-ID")), h.get("WARC-Target-URI"), kind, page_of(h.get("WARC-Refers-To")), size, sha, x.payload if payloads and full else None))
                types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                for i in range(0, len(out), 500):
                    cols = list(zip(*out[i : i + 500], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, FOUND)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages as archives in the shared folder and reads the records back; what each record says is kept there, the
    archives go. Quarantined gaps, which archives just written should not have, are counted in a warning."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, least)
    found = cut(read_archives(spark, path, payloads=False), "records")
    lost = found.filter("reason IS NOT NULL").agg(F.count("*").alias("gaps"), F.sum("length").alias("bytes")).first()
    if lost.gaps:
        logging.getLogger(__name__).warning("%d quarantined gaps of %d bytes in %s", lost.gaps, lost.bytes, path)
    else:
        remove(spark, path)
    return found.filter("reason IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
