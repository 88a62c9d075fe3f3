"""WARC archives: write a record per page, read them back record by record.

Every record is a gzip member of its own. Of pages with equal payloads the one
with the smallest id (null last; of repeated rows the first) is written whole as
a response, the others as revisits that name its record and have no payload.

The reader goes through an archive once: it inflates as it reads, takes a
record's header up to the empty line, frames the block by its content length,
hashes the payload as it passes and compares it with the digest in the header.
It holds one piece of the file and one header, whatever the size of a record.

Null html is an empty payload, a null url leaves its header out, and control
characters in a url are escaped. Archives go to the shared folder under names
no other attempt has; the manifest, which Spark commits, lists those of the
attempts that succeeded. No pages, no archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagewatch.durable import stored
from pagewatch.llm.common import text_of
from pagewatch.llm.id_files import file_system, new_folder

#: An archive is closed, and the next begun, once it has this many bytes of records.
ARCHIVE_BYTES = 64 << 20
PIECE = 1 << 16
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:page-records")


def digest_of(payload_sha1: bytes) -> str:
    return base64.b32encode(payload_sha1).decode()


def record_id(page_id: object, digest: str, row: int | None = None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}:{digest}:{"" if row is None else row}')}>"


def record(kind: str, own_id: str, page_id: object, url: str | None, digest: str, payload: bytes | None, refers_to: str | None) -> bytes:
    """One record as a gzip member."""
    head = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8"]
    block = b"\r\n".join(head) + b"\r\n\r\n" + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own_id}", f"WARC-Date: {DATE}"]
    if url is not None:
        escaped = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        lines.append(f"WARC-Target-URI: {escaped}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    head_bytes = "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n"
    return pack.compress(head_bytes) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


@dataclass
class Record:
    headers: dict[str, str]
    payload_bytes: int = 0
    digest: str = ""
    pieces: list[bytes] = field(default_factory=list)


class Members:
    """The inflated bytes of one gzip member after another."""

    def __init__(self, file):
        self.file, self.raw, self.ended = file, b"", False
        self.state = None

    def next_member(self) -> bool:
        if not self.raw:
            self.raw = self.file.read(PIECE)
        self.state = zlib.decompressobj(31) if self.raw else None
        return self.state is not None

    def piece(self) -> bytes:
        """Some more bytes of the member; none at its end."""
        while not self.state.eof:
            if not self.raw and not self.state.unconsumed_tail:
                self.raw = self.file.read(PIECE)
                if not self.raw:
                    raise ValueError("the archive ends within a record")
            given = self.state.unconsumed_tail + self.raw if self.state.unconsumed_tail else self.raw
            out = self.state.decompress(given, PIECE)
            self.raw = self.state.unused_data if self.state.eof else b""
            if out:
                return out
        return b""


def read_records(file, with_payload: bool = False) -> Iterator[Record]:
    """The records of an archive, in order; payloads are verified and kept only if asked for."""
    members = Members(file)
    while members.next_member():
        held = b""
        while b"\r\n\r\n" not in held:
            more = members.piece()
            if not more:
                raise ValueError("a record without an end of its header")
            held += more
        head, _, held = held.partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a record")
        found = Record({k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)})
        left, sha, http = int(found.headers["content-length"]), hashlib.sha1(), b""
        in_payload = False
        while left:
            if not held:
                held = members.piece()
                if not held:
                    raise ValueError("a record shorter than its content length")
            part, held = held[:left], held[left:]
            left -= len(part)
            if not in_payload:
                http += part
                if b"\r\n\r\n" not in http:
                    continue
                part, in_payload = http.partition(b"\r\n\r\n")[2], True
            sha.update(part)
            found.payload_bytes += len(part)
            if with_payload:
                found.pieces.append(part)
        while more := members.piece():
            held += more
        if held != b"\r\n\r\n":
            raise ValueError("a record longer than its content length")
        found.digest = digest_of(sha.digest())
        if found.headers["warc-type"] == "response" and found.headers["warc-payload-digest"] != f"sha1:{found.digest}":
            raise ValueError(f"digest mismatch in {found.headers['warc-record-id']}")
        yield found


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html); the manifest: path, records.

    ``pages`` is read twice and has to come in the same order both times, as a
    table does. Equal payloads meet as a minimum taken before the shuffle; a
    payload that many pages share is a key Spark can split in the join.
    """
    rows = pages.select(
        F.col("page_id").alias("page"), F.col("url").alias("link"), text_of("html").alias("body"), F.monotonically_increasing_id().alias("row")
    )
    rows = rows.withColumns({"sha": F.sha1(F.col("body").cast("binary")), "bytes": F.octet_length("body").cast("long")})
    first = F.min(F.struct(F.col("page").isNull().alias("none"), "page", "row")).alias("first")
    firsts = rows.filter(F.col("bytes") >= min_bytes).groupBy("sha", "bytes").agg(first)
    firsts = firsts.select(F.col("sha").alias("its_sha"), F.col("bytes").alias("its_bytes"), "first")
    met = rows.join(firsts, (F.col("sha") == F.col("its_sha")) & (F.col("bytes") == F.col("its_bytes")), "left")
    revisit = F.coalesce(F.col("row") != F.col("first.row"), F.lit(False))
    records = met.select(
        "page", "link", "row", "sha", F.when(~revisit, F.col("body")).alias("body"), revisit.alias("revisit"), F.col("first.page").alias("to_page"), F.col("first.row").alias("to_row")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        out, name, size, count, done = None, "", 0, 0, []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for page, link, row, sha, body, again, to_page, to_row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    if out is None:
                        store.create_dir(root, recursive=True)
                        name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                        out, size, count = store.open_output_stream(name, compression=None), 0, 0
                    digest = digest_of(bytes.fromhex(sha))
                    to = record_id(to_page, digest, to_row) if again else None
                    payload = None if again else body.encode("utf-8", "surrogatepass")
                    size += out.write(record("revisit" if again else "response", record_id(page, digest, row), page, link, digest, payload, to))
                    count += 1
                    if size >= archive_bytes:
                        out.close()
                        done.append((name, count))
                        out = None
        if out is not None:
            out.close()
            done.append((name, count))
        if done:
            yield pa.RecordBatch.from_pydict({"path": [n for n, _ in done], "records": pa.array([c for _, c in done], pa.int64())})

    return stored(records.mapInArrow(run, "path string, records bigint"))


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives, one task per archive: record_type, record, refers, page, url, payload_bytes, payload_digest, stated_digest."""
    names = ("record_type", "record", "refers", "page", "url", "payload_digest", "stated_digest")
    layout = pa.schema([*[(n, pa.string()) for n in names], ("payload_bytes", pa.int64())])

    def row(r: Record) -> tuple:
        h = r.headers
        stated = h["warc-payload-digest"].removeprefix("sha1:")
        return (h["warc-type"], h["warc-record-id"], h.get("warc-refers-to"), h.get("x-page-id"), h.get("warc-target-uri"), r.digest, stated, r.payload_bytes)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), layout, strict=True)], schema=layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = file_system(folder)[0]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with store.open_input_stream(path, compression=None) as file:
                    for found in read_records(file):
                        rows.append(row(found))
                        if len(rows) == 2048:
                            yield out(rows)
                            rows = []
                if rows:
                    yield out(rows)

    files = max(1, manifest.count())
    spread = manifest.select("path").repartitionByRange(files, "path")
    return spread.mapInArrow(run, ", ".join(f"{f.name} {'bigint' if f.name == 'payload_bytes' else 'string'}" for f in layout))


def resolved(records: DataFrame) -> DataFrame:
    """Records with revisits given the size, digest and page of the response they name.

    A revisit whose response is missing, or has another digest than the revisit
    states, is an error.
    """
    whole = records.filter("record_type = 'response'").select(
        F.col("record").alias("its_record"), F.col("page").alias("its_page"), F.col("payload_bytes").alias("its_bytes"), F.col("payload_digest").alias("its_digest")
    )
    met = records.join(whole, F.col("refers") == F.col("its_record"), "left")
    revisit = F.col("record_type") == "revisit"
    sound = ~revisit | F.coalesce(F.col("its_digest") == F.col("stated_digest"), F.lit(False))
    return met.select(
        "page",
        "url",
        "record_type",
        F.when(revisit, F.col("its_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(~sound, F.raise_error(F.lit("a revisit without its response")))
        .when(revisit, F.col("its_digest"))
        .otherwise(F.col("payload_digest"))
        .alias("payload_digest"),
        F.when(revisit, F.col("its_page")).alias("refers_to"),
    )


def op3_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = new_folder(spark, "warc")
    records = stored(read_archives(write_archives(pages, folder), folder))
    kind = pages.schema["page_id"].dataType
    return resolved(records).select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


# DuckDB's sha1 is in hex; each five bits make a letter of the digest.
SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS payload_bytes, hex, min(page_id) OVER (PARTITION BY hex) AS first_page FROM p
), b AS (
  SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, (k // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (k % 8))) & 31)::INTEGER + 1, 1) for k in range(0, 32)], '') AS payload_digest FROM d
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM b
"""
