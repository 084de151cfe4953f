"""WARC archives: a writer with one gzip member per record, and a sequential reader.

The reader decompresses in steps of CHUNK bytes, frames each record by its Content-Length and checks the block's and
the payload's SHA-1; it never holds more than a header and one step unless the payload is asked for.  A corrupt
member, a wrong length or a wrong digest raises WarcError.

Of rows with equal payloads of at least MIN_REVISIT bytes, the one with the largest page_id is written as response, the
others as revisit records that keep the HTTP header (with the full length) and the payload's digest but no payload.

Archives are written by tasks straight into the shared folder.  A task names its files in the rows it returns, and
only rows of tasks that Spark has committed reach the manifest, so a task that is run again leaves no trace.

Record ids are fresh UUIDs; the page of a record and the page a revisit refers to stand in header fields of our own.  Archives of others
can be read: warcinfo, request, metadata and other records give rows too (their whole block is the payload unless it is HTTP), folded
header lines are joined, digests may be base 32 or hex, other digests than SHA-1 are not checked, and HTTP lengths only where the body is
stored as it was sent.

Defined results: null html is an empty payload; a null url gives no WARC-Target-URI; a null page_id makes a response
unless an equal payload has an id; rows that repeat both id and payload are all written as the largest id's response;
an empty table gives one empty manifest and no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, small, stage

MIN_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE, REQUEST_TYPE = "application/http;msgtype=response", "application/http;msgtype=request"
#: Our own header fields: the page of a record, and the page whose response a revisit refers to.
PAGE, REFERS_TO = "Spanloom-Page", "Spanloom-Refers-To-Page"


class WarcError(ValueError):
    """An archive that is cut off, malformed or fails a digest."""


def label(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def sha1_of(digest: str | None) -> bytes | None:
    """The SHA-1 that a digest header gives in base 32 or as hex digits; null for other kinds."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())
    except ValueError as e:
        raise WarcError(f"not a digest: {digest!r}") from e


def same_digest(header: str | None, sha1: bytes) -> bool:
    """Whether a header agrees; one that is missing or of another kind is not checked."""
    told = sha1_of(header)
    return told is None or told == sha1


def record(page_id: int | None, url: str | None, payload: bytes, n_bytes: int, payload_sha1: bytes, refers_to: int | None = None, level: int = 6) -> bytes:
    """One gzip member.  For a revisit, payload is empty while n_bytes and payload_sha1 are those of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block_sha1 = hashlib.sha1(http)
    block_sha1.update(payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}",
        *([] if page_id is None else [f"{PAGE}: {page_id}"]),
        *([] if url is None else ["WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~")]),
        f"Content-Type: {HTTP_TYPE}", f"WARC-Payload-Digest: {label(payload_sha1)}", f"WARC-Block-Digest: {label(block_sha1.digest())}",
        *([] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"{REFERS_TO}: {refers_to}"]),
        f"Content-Length: {len(http) + len(payload)}",
    ]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join([z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http), z.compress(payload), z.compress(b"\r\n\r\n"), z.flush()])


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload_bytes: int = 0  # of the payload in this record; a revisit has none
    payload_sha1: str = hashlib.sha1(b"").hexdigest()
    payload: bytes | None = None


class _Member:
    """The bytes of one gzip member, decompressed step by step; rest holds what follows it."""

    def __init__(self, stream: BinaryIO, rest: bytes):
        self.stream, self.z, self.raw, self.plain = stream, zlib.decompressobj(31), rest, b""

    def more(self) -> bool:
        """Adds to plain; false at the member's end."""
        while not self.z.eof:
            self.raw = self.raw or self.stream.read(CHUNK)
            if not self.raw:
                raise WarcError("archive ends inside a member")
            try:
                got = self.z.decompress(self.raw, CHUNK)
            except zlib.error as e:
                raise WarcError(f"corrupt member: {e}") from e
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if got:
                self.plain += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        while (at := self.plain.find(mark)) < 0:
            if not self.more():
                raise WarcError("member ends inside a header")
        out, self.plain = self.plain[:at], self.plain[at + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.plain and not self.more():
                raise WarcError("member is shorter than its Content-Length")
            out, self.plain = self.plain[:n], self.plain[n:]
            n -= len(out)
            yield out


def fields(lines: list[str]) -> dict[str, str]:
    """Names in lower case; a line that begins with white space goes on with the value before it."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] = f"{out[name]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"not a header line: {line[:80]!r}")
        name = name.strip().lower()
        out[name] = value.strip()
    return out


def read_records(stream: BinaryIO, payloads: bool = False) -> Iterator[Record]:
    """The records of an archive in order, each verified."""
    rest = b""
    while rest or (rest := stream.read(CHUNK)):
        m = _Member(stream, rest)
        version, *lines = m.until(b"\r\n\r\n").decode("utf-8").split("\r\n")
        if not version.startswith("WARC/1."):
            raise WarcError(f"not a WARC record: {version[:20]!r}")
        r = Record(fields(lines))
        if not r.headers.get("content-length", "").isdigit():
            raise WarcError("record without a Content-Length")
        left = int(r.headers["content-length"])
        block, payload, kept, head = hashlib.sha1(), hashlib.sha1(), [], b""
        is_http = r.headers.get("content-type", "").replace(" ", "").lower() in (HTTP_TYPE, REQUEST_TYPE) and left > 0
        in_head = is_http
        for part in m.take(left):
            block.update(part)
            if in_head:
                head += part
                at = head.find(b"\r\n\r\n")
                if at < 0:
                    continue
                in_head, part = False, head[at + 4 :]
                r.http = fields(head[:at].decode("latin-1").split("\r\n")[1:])
            payload.update(part)
            r.payload_bytes += len(part)
            if payloads:
                kept.append(part)
        if b"".join(m.take(4)) != b"\r\n\r\n" or m.plain or m.more():
            raise WarcError("member does not end after its record")
        if in_head:
            raise WarcError("block ends inside its HTTP header")
        r.payload_sha1 = payload.hexdigest()
        if not same_digest(r.headers.get("warc-block-digest"), block.digest()):
            raise WarcError("block digest differs")
        if r.headers.get("warc-type") != "revisit":
            if not same_digest(r.headers.get("warc-payload-digest"), payload.digest()):
                raise WarcError("payload digest differs")
            # What was sent in pieces or packed may be stored unpacked, under the length that went over the wire.
            as_sent = not {"transfer-encoding", "content-encoding"} & r.http.keys()
            if r.headers.get("warc-type") == "response" and as_sent and r.http.get("content-length", "x").isdigit() and int(r.http["content-length"]) != r.payload_bytes and "warc-truncated" not in r.headers:
                raise WarcError("HTTP Content-Length differs from the payload")
        r.payload = b"".join(kept) if payloads else None
        rest = m.raw
        yield r


def number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def digest_rows(r: Record) -> dict:
    """A record as a row.  Of a revisit, length and digest are those it tells of the full payload; of all others those of what was read."""
    told = sha1_of(r.headers.get("warc-payload-digest")) if r.headers.get("warc-type") == "revisit" else None
    length = number(r.http.get("content-length")) if told else None
    return {
        "page_id": number(r.headers.get(PAGE.lower())), "url": r.headers.get("warc-target-uri"), "payload_bytes": r.payload_bytes if length is None else length, "payload_digest": told.hex() if told else r.payload_sha1,
        "record_type": r.headers.get("warc-type"), "refers_to": number(r.headers.get(REFERS_TO.lower())),
    }


MANIFEST = "archive string, records long, bytes long"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def write_archives(pages: DataFrame, path: str | None = None, archive_bytes: int = ARCHIVE_BYTES, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """Writes an archive record for every row and returns the manifest: archive, records, bytes."""
    path = path or new_path(pages.sparkSession, "warc")
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"))
    rows = rows.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    copies = stage(rows.where(F.col("n_bytes") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 AND last IS NOT NULL").select(F.col("digest").alias("same"), "last"), "warc-copies")
    revisit = (F.col("n_bytes") >= MIN_REVISIT) & (F.col("page_id").isNull() | (F.col("page_id") != F.col("last")))
    rows = rows.join(small(copies), F.col("digest") == F.col("same"), "left").withColumn("refers_to", F.when(revisit, F.col("last")))
    rows = rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "n_bytes", "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        out, name, done, size = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"archive": name, "records": done, "bytes": size}], pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for b in batches:
            for page_id, url, payload, n, digest, refers_to in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if out is None:
                    name, done, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                data = record(page_id, url, payload or b"", n, bytes.fromhex(digest), refers_to)
                out.write(data)
                done, size = done + 1, size + len(data)
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    listed = stage(rows.mapInArrow(write, MANIFEST), "warc-manifest")
    return listed.withColumn("archive", F.concat(F.lit(path + "/"), "archive"))


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row for each record of the listed archives, one task an archive; the records of each are counted against the manifest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for uri, expected in zip(b.column("archive").to_pylist(), b.column("records").to_pylist(), strict=True):
                store, path = fs.FileSystem.from_uri(uri)
                seen, rows = 0, []
                with store.open_input_stream(path, compression=None) as stream:
                    for r in read_records(stream):
                        rows.append(digest_rows(r))
                        seen += 1
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if seen != expected:
                    raise WarcError(f"{uri} has {seen} records, {expected} were written")
                yield pa.RecordBatch.from_pylist(rows, schema)

    archives = manifest.count()
    return manifest.select("archive", "records").repartition(max(1, archives)).mapInArrow(read, READ)


def query(pages: DataFrame) -> DataFrame:
    return read_archives(write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle() -> str:
    return f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> last THEN last END AS refers_to FROM m"""
