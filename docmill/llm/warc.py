"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Every record is a gzip member of its own.  The first of the records with equal
payloads (the smallest id) is a ``response``; the others are ``revisit`` records
that refer to it and keep the HTTP header, with the full payload's length, and
the payload's digest.

The reader does not need an index.  Files are cut into byte ranges; a task looks
for gzip magic from the start of its range, accepts a place as a member only if
it inflates to a whole WARC header, however long that is, and from there goes
from member to member.  It owns the records that start inside its range, so each
is read exactly once wherever the cuts lie, and a member may end beyond the range.

Files are written and read through Arrow's file systems by URI, so any shared
store it knows will do.  A task writes a file under a name of its own; only
files in the manifest that successful tasks return are read, so attempts that
were lost or repeated leave nothing in the results.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.runtime import fresh_path, looked_up, utf8, written

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range, of a read, and of what is inflated at a time while a header's end is looked for.
SPLIT, READ, STEP = 4 << 20, 1 << 18, 1 << 16
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:docmill:record:"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _plain(url: str | None) -> str:
    """A header value: control characters and blanks percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record_of(kind: str, record_id: str, date: str, url: str | None, payload: bytes | None, length: int, digest: str, refers_to: str | None) -> bytes:
    """One record, uncompressed.  A revisit's block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"" if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{RECORD}{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_plain(url)}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD}{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write an archive a task into ``folder`` (a URI); returns the manifest ``(path, bytes, records)``.

    Of records with equal payloads of at least ``least`` bytes the one with the
    smallest id is a response, the others revisit it.  Null payloads are empty.
    Rows with a null id revisit a row with one, if there is any with their
    payload, and are responses otherwise; repeated rows of the smallest id are
    all responses.  Null urls are empty; urls and payloads may be of any length;
    further columns play no part, and an empty table gives an empty manifest.

    The first ids are found on digests alone.  Payloads with many copies are known
    before anything is exchanged, and their copies leave theirs behind.
    """
    rows = pages.select(F.col(id_col).cast("string").alias("rid"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), utf8(F.coalesce(F.col(payload_col), F.lit(""))).alias("payload"))
    rows = rows.withColumn("n", F.octet_length("payload").cast("bigint")).withColumn("sha", F.sha1("payload"))
    firsts = written(rows.groupBy("sha", "n").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "firsts")
    total = firsts.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]

    def lighter(found: DataFrame, hot: Column) -> DataFrame:
        first = F.col("hot_.first")
        left = hot & (F.col("n") >= least) & first.isNotNull() & ~F.col("id").eqNullSafe(first)
        return found.withColumn("payload", F.when(~left, F.col("payload")))

    joined = looked_up(rows, firsts, ["sha", "n"], "copies", total, lighter)
    again = (F.col("n") >= least) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    out = joined.select(
        F.coalesce("rid", F.lit("")).alias("rid"), "url", F.when(~again, F.col("payload")).alias("payload"), "n", "sha", F.when(again, F.col("first").cast("string")).alias("refers")
    )
    fs, path = arrow_fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = arrow_fs.FileSystem.from_uri(folder)
        name, out, size, records = f"{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for rid, url, payload, n, sha, refers in zip(*(batch.column(i) for i in range(6)), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    info = b"software: docmill\r\nformat: WARC File Format 1.1\r\n"
                    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                    size += out.write(gzipped(head.encode() + info + b"\r\n\r\n"))
                refers = refers.as_py()
                digest = base64.b32encode(bytes.fromhex(sha.as_py())).decode()
                member = gzipped(record_of("response" if refers is None else "revisit", rid.as_py(), date, url.as_py(), payload.as_py(), n.as_py(), digest, refers))
                size += out.write(member)
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], ["path", "bytes", "records"])

    return written(out.mapInArrow(run, "path string, bytes bigint, records bigint"), "manifest")


class Window:
    """Reads a file forward in blocks, and again from anywhere."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size = file, size

    def read(self, at: int, n: int = READ) -> bytes:
        self.file.seek(at)
        return self.file.read(min(n, self.size - at)) if at < self.size else b""


def header_at(window: Window, at: int) -> bool:
    """Does a gzip member that starts here inflate to the whole header of a WARC record?

    A place that does not begin like a record is given up at once; a header that
    does is inflated, a step at a time, until the blank line that ends it.
    """
    z, seen, pos, data = zlib.decompressobj(31), bytearray(), at, b""
    try:
        while not z.eof:
            if not data:
                data = window.read(pos, 4096 if pos == at else READ)
                pos += len(data)
            searched, over = max(0, len(seen) - 3), not data
            seen += z.flush() if over else z.decompress(data, STEP)
            data = z.unconsumed_tail
            if not b"WARC/".startswith(seen[:5]):
                return False
            stop = seen.find(b"\r\n\r\n", searched)
            if stop >= 0:
                return re.search(rb"(?i)\r\nContent-Length:\s*\d+", bytes(seen[:stop])) is not None
            if over:
                break
    except zlib.error:
        pass
    return False


def member_at(window: Window, at: int) -> tuple[bytes, int]:
    """The inflated member that starts here, and where it ends."""
    z, parts, pos = zlib.decompressobj(31), [], at
    while not z.eof:
        data = window.read(pos)
        if not data:
            raise zlib.error("the member is cut off")
        parts.append(z.decompress(data))
        pos += len(data)
    return b"".join(parts), pos - len(z.unused_data)


def next_member(window: Window, at: int, end: int) -> int | None:
    """The first place from ``at``, before ``end``, where a record's member starts."""
    while at < end:
        block = window.read(at, READ)
        if not block:
            return None
        found = block.find(MAGIC)
        while found >= 0 and at + found < end:
            if header_at(window, at + found):
                return at + found
            found = block.find(MAGIC, found + 1)
        at += max(1, len(block) - len(MAGIC) + 1)
    return None


def records_in(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an inflated member: header fields (names lower-cased) and block."""
    at = 0
    while data.startswith(b"WARC/", at):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(head.get("content-length", "0"))
        yield head, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


def read_range(file, size: int, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records whose member starts in [start, end)."""
    window = Window(file, size)
    at = next_member(window, start, end)
    while at is not None and at < end:
        try:
            data, after = member_at(window, at)
        except zlib.error:  # damaged: look for the next one
            at = next_member(window, at + 1, end)
            continue
        yield from records_in(data)
        at = after if window.read(after, 3) == MAGIC else next_member(window, after, end)


SCHEMA = "record_id string, record_type string, url string, refers_to string, payload_digest string, http_length bigint, payload binary"


def read(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """All response and revisit records of the files ``(path, bytes)``.

    Columns: ``record_id, record_type, url, refers_to, payload_digest`` (as the
    header has it), ``http_length`` (of the HTTP header) and ``payload`` (null
    for a revisit).
    """
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split).cast("bigint"))).alias("start"))
    spread = ranges.repartition(max(1, min(4096, ranges.count())), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        for batch in batches:
            for path, size, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fs, inner = arrow_fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with fs.open_input_file(inner) as f:
                    for head, block in read_range(f, size, start, min(size, start + split)):
                        if head.get("warc-type") not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = re.search(rb"(?i)\r\nContent-Length:\s*(\d+)", http)
                        response = head["warc-type"] == "response"
                        rows.append((
                            head.get("warc-record-id", "").strip("<>"), head["warc-type"], head.get("warc-target-uri"), head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None,
                            head.get("warc-payload-digest"), int(length[1]) if length else None, payload if response else None,
                        ))
                        held += len(block)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return spread.select("path", "bytes", "start").mapInArrow(run, SCHEMA)


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder, then read these back; the digest columns.

    Nulls, repeated rows, very long texts and empty tables: see :func:`write`.
    """
    id_type = pages.schema["page_id"].dataType
    manifest = write(pages, fresh_path(spark, "warc"), least=least)
    records = read(manifest)
    number = lambda c: F.when(F.startswith(c, F.lit(RECORD)) & (F.length(c) > len(RECORD)), F.substring(c, len(RECORD) + 1, F.length(c))).cast(id_type)
    whole = F.col("record_type") == "response"
    return records.select(
        number(F.col("record_id")).alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("bigint")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(whole, base32(F.sha1("payload"))).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        number(F.col("refers_to")).alias("refers_to"),
    )


def base32(hex_: Column) -> Column:
    """Base32 of 40 hex digits, in column functions: eight digits of five bits from each ten hex digits."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    digit = lambda q, i: F.substring(alphabet, (F.shiftright(q, 35 - 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    parts = []
    for k in range(4):
        q = F.conv(F.substring(hex_, 10 * k + 1, 10), 16, 10).cast("bigint")
        parts += [digit(q, i) for i in range(8)]
    return F.concat(*parts)
