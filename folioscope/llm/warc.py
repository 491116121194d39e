"""WARC archives: a writer with identical-payload revisits and a salvage reader.

Each record is a gzip member of its own, so damage to one leaves the others readable.  The
archives are written by Spark's own file sink, which commits whole files and retries lost tasks:
a task rolls its members into archives of bounded size, each a row of the sink and a file of its
own.  A member's last byte is the top byte of its length, zero for records under 16 MiB, and that
byte is the sink's line separator.  Larger records become several members.

The round trip spoils its archives on purpose: before three records in 16, picked by a digest of
their page_id, it writes junk, a member whose checksum fails, or a whole member whose record
belies its payload digest.  All true records must be recovered from between them.

The reader checks every member and record (version line, headers, length, closing blank lines,
payload digest).  After a check fails it searches for the next valid member or version line,
recovers what follows, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_batches

MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER_BYTES = (1 << 24) - 1
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

#: Bytes of an archive, beyond which the next one begins.
ARCHIVE_BYTES = 16 << 20

READ = "path string, start long, end long, inner_start long, inner_end long, recovered boolean, kind string, warc_type string, record_id string, target_uri string, refers_to string, stated_digest string, payload_bytes long, payload_digest string, payload binary, reason string"


class Found(NamedTuple):
    """A record or a gap; start and end are bytes of the stream that was parsed, `inner` those within the member's data."""

    start: int
    end: int
    headers: dict[str, str] | None
    payload: bytes | None
    reason: str
    inner: tuple[int, int] | None = None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP headers but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(data: bytes, level: int = 6) -> bytes:
    """data as gzip members of at most MEMBER_BYTES each."""
    out = []
    for start in range(0, len(data), MEMBER_BYTES):
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += [packer.compress(data[start : start + MEMBER_BYTES]), packer.flush()]
    return b"".join(out)


def _record_at(data: bytes, at: int) -> tuple[Found, bool]:
    """The record that starts at `at`, or why there is none and whether its frame holds nevertheless."""
    if not (version := VERSION.match(data, at)):
        return Found(at, at, None, None, "no version line"), False
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return Found(at, at, None, None, "headers without an end"), False
    headers: dict[str, str] = {}
    for line in data[version.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return Found(at, at, None, None, "bad header line"), False
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if absent := [h for h in REQUIRED if h not in headers]:
        return Found(at, at, None, None, f"no {absent[0]}"), False
    length = headers["content-length"]
    if not re.fullmatch(r"[0-9]{1,18}", length):
        return Found(at, at, None, None, "bad content length"), False
    body = stop + 4
    end = body + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return Found(at, at, None, None, "truncated" if end + 4 > len(data) else "no blank lines after the block"), False
    block = data[body:end]
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        head = block.find(b"\r\n\r\n")
        if head < 0:
            return Found(at, end + 4, None, None, "bad HTTP headers"), True
        headers |= {f"http:{k.decode('latin-1').strip().lower()}": v.decode("latin-1").strip() for k, _, v in (x.partition(b":") for x in block[:head].split(b"\r\n")[1:])}
        payload = block[head + 4 :]
    stated = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and stated.startswith("sha256:") and hashlib.sha256(payload).hexdigest() != stated[7:]:
        return Found(at, end + 4, None, None, "payload digest differs"), True
    return Found(at, end + 4, headers, payload, ""), True


def records(data: bytes) -> Iterator[Found]:
    """Records of an uncompressed stream and the gaps between, in order."""
    at = 0
    while at < len(data):
        found, framed = _record_at(data, at)
        if found.headers is not None:
            yield found
            at = found.end
            continue
        reason, search = found.reason, found.end if framed else at + 1
        while True:
            after = VERSION.search(data, search)
            if after is None:
                at, end = len(data), len(data)
                break
            end = after.start()
            if _record_at(data, end)[0].headers is not None:
                break
            search = end + 1
        yield Found(found.start, end, None, None, reason)
        at = end


def _member_at(data: memoryview, at: int, step: int = 1 << 16) -> tuple[bytes, int] | None:
    """What the gzip member at `at` holds and where it ends; None if it fails a check."""
    unpack = zlib.decompressobj(31)
    parts, pos = [], at
    try:
        while not unpack.eof:
            if pos >= len(data):
                return None
            parts.append(unpack.decompress(data[pos : pos + step]))
            pos += step
    except zlib.error:
        return None
    return b"".join(parts), min(pos, len(data)) - len(unpack.unused_data)


def salvage(data: bytes) -> Iterator[Found]:
    """Records and gaps of an archive, gzipped by member or not.

    In a gzipped archive, start and end of a record are those of its member, and a record may go
    on over several members.
    """
    if not data.startswith(MAGIC) and (VERSION.match(data) or MAGIC not in data):
        yield from records(data)
        return
    view, at = memoryview(data), 0
    held: list[bytes] = []  # members of a record that isn't complete
    held_at, size, need = 0, 0, None
    while at < len(data):
        member = _member_at(view, at) if data.startswith(MAGIC, at) else None
        if member is not None:
            text, end = member
            if held and VERSION.match(text):
                yield Found(held_at, at, None, None, "record without its last part")
                held = []
            if not held:
                held_at, size, need = at, 0, None
            held.append(text)
            size += len(text)
            at = end
            if need is None:  # unknown while the headers go on
                need = _length_at(b"".join(held))
            if (need is None or size < need) and len(text) >= MEMBER_BYTES:
                continue
            for f in records(b"".join(held)):
                yield Found(held_at, end, f.headers, f.payload, f.reason, (f.start, f.end))
            held = []
            continue
        if held:
            yield Found(held_at, at, None, None, "record without its last part")
            held = []
        start, reason = at, "bad gzip member" if data.startswith(MAGIC, at) else "no gzip member"
        while True:
            at = data.find(MAGIC, at + 1)
            if at < 0:
                at = len(data)
                break
            member = _member_at(view, at)
            if member is not None and VERSION.match(member[0]):
                break
        yield Found(start, at, None, None, reason)
    if held:
        yield Found(held_at, len(data), None, None, "record without its last part")


def _length_at(data: bytes) -> int | None:
    """Bytes of the record that data begins with, as its headers have it; 0 if they don't say, None if they haven't ended."""
    stop = data.find(b"\r\n\r\n")
    if not VERSION.match(data):
        return 0
    if stop < 0:
        return None
    length = re.search(rb"\r\ncontent-length[ \t]*:[ \t]*([0-9]{1,18})[ \t]*(?:\r\n|$)", data[: stop + 2], re.IGNORECASE)
    return stop + 4 + int(length[1]) + 4 if length else 0


def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, digest and refers_to, which is set where an equal payload of `least` bytes has a smaller page_id."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    firsts = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    refers = F.when((F.col("first") < F.col("page_id")) | F.col("page_id").isNull(), F.col("first"))
    return rows.join(firsts, "digest", "left").withColumn("refers_to", refers).drop("first")


def damage(page_id: int | None, url: str | None, payload: bytes, packed: bytes) -> bytes:
    """What is written before a record to spoil its archive: junk, a broken member or a lying record; for most nothing."""
    pick = hashlib.md5(str(page_id).encode()).hexdigest()[0] if page_id is not None else "f"
    if pick == "0":
        return b"\x00junk " + hashlib.sha256(str(page_id).encode()).digest() * 3
    if pick == "1":
        return packed[:-8] + bytes([packed[-8] ^ 255]) + packed[-7:]
    if pick == "2":
        return members(record(page_id, url, payload + b"x", hashlib.sha256(payload).hexdigest(), None, False))
    return b""


def write_archives(pages: DataFrame, path: str, least: int = 100, archive_bytes: int = ARCHIVE_BYTES, spoil: bool = False) -> None:
    """Write a record for each row of pages (page_id, url, html) below `path`, into archives of about `archive_bytes`.

    A null html is an empty payload, a null url leaves its header out and a null page_id is empty
    in the record's name.  Payloads are written whole, a long one into an archive that is the
    larger by it; each of several equal rows gives a record; an empty table gives no record.
    Other columns are ignored.  `spoil` puts damage between records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])  # the separator gives the last byte, which is zero

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                page, url, payload, digest, refers = (x.as_py() for x in row)
                packed = members(record(page, url, payload, digest, refers, refers is not None))
                if spoil:
                    held.append(damage(page, url, payload, packed))
                    size += len(held[-1])
                held.append(packed)
                size += len(packed)
                if size >= archive_bytes:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    small_batches(pages.sparkSession)
    rows = with_revisits(pages, least).select("page_id", "url", "payload", "digest", "refers_to")
    packed = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record (kind record) and each quarantined gap (kind gap, with a reason) of the archives below `path`.

    start and end are bytes of the archive, for a gzip member the member's; inner_start and
    inner_end tell the bytes within its data.  `recovered` tells records found after a gap that
    nothing else parts them from.  Missing headers are null; a revisit has neither length nor
    digest of its own; an empty archive, or none, gives no rows; equal records give equal rows.
    An archive is held whole, with the one record that is being read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("inner_start", pa.int64()), ("inner_end", pa.int64()), ("recovered", pa.bool_()), *((n, pa.string()) for n in ("kind", "warc_type", "record_id", "target_uri", "refers_to", "stated_digest")), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("reason", pa.string())])
        for batch in batches:
            for where, content in zip(batch.column(0), batch.column(1), strict=True):
                out, size, after_gap = [], 0, False
                for f in salvage(content.as_py()):
                    h, inner = f.headers, f.inner or (None, None)
                    if h is None:
                        out.append((where.as_py(), f.start, f.end, *inner, False, "gap", *[None] * 8, f.reason))
                    else:
                        stated = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                        revisit = h.get("warc-type") == "revisit"
                        out.append((where.as_py(), f.start, f.end, *inner, after_gap, "record", h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), stated, None if revisit else len(f.payload), None if revisit else hashlib.sha256(f.payload).hexdigest(), f.payload if payloads else None, None))
                        size += len(f.payload) if payloads else 0
                    after_gap = h is None
                    if len(out) >= 5000 or size >= 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, READ)


def _page(column: str) -> Column:
    return F.regexp_extract(column, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def round_trip(pages: DataFrame, least: int = 100, path: str | None = None) -> DataFrame:
    """Write pages to archives, spoil them and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, recovered.

    `recovered` tells the records that follow damage.  What was read, quarantined gaps and all, is
    a table at `path` with `-log` appended.  Needs page_id, url and html; other columns are
    ignored.  A null html is an empty payload and a null url leaves its header out.  A revisit's
    length and digest are those of the response it refers to, as read back.  Rows that repeat the
    smallest page_id of a payload are responses all; a null page_id is larger than any other and
    is never referred to.  An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = path or shared_dir(spark, "warc")
    write_archives(pages, path, least, spoil=True)
    read_archives(spark, path, payloads=False).drop("payload").write.option("compression", "zstd").parquet(f"{path}-log")
    read = spark.read.parquet(f"{path}-log").where("kind = 'record'")
    read = read.select(_page("record_id").alias("page_id"), "warc_type", _page("refers_to").alias("refers_to"), "payload_bytes", "payload_digest", "stated_digest", "recovered")
    whole = read.where("warc_type = 'response'").select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "recovered")
    # One row for each page and digest, so a join to it repeats nothing.
    targets = whole.groupBy(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest")).agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = read.where("warc_type = 'revisit'").select("page_id", "refers_to", "stated_digest", "recovered")
    resolved = revisits.join(targets, (F.col("refers_to") == F.col("_page")) & (F.col("stated_digest") == F.col("_digest")), "left")
    return whole.unionByName(resolved.select("page_id", "payload_bytes", F.col("_digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to", "recovered"))


SQL = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
    f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN first < page_id THEN first END AS refers_to, coalesce(left(md5(CAST(page_id AS VARCHAR)), 1) IN ('0', '1', '2'), false) AS recovered
    FROM f"""
