"""WARC archives and a chunked record table.

Writing. Each row becomes a record in a gzip member of its own. Of rows with equal payloads (of at least
``min_revisit_bytes``), that with the smallest page_id is a response and the others are revisits that refer to
it and carry the original's HTTP header, but no payload. Every task writes one archive into the shared folder
and returns its path; only archives in that (checkpointed) list are read, so what a lost attempt left behind is
never seen.

Reading. Every partition of the list is read by a task of its own (the list has one for each writer). An archive
is streamed; a payload comes out as rows (path, record_no, chunk_no) of at most ``chunk_bytes`` each, with the
SHA-1 of all bytes so far, so the last chunk's is the payload's. No whole record is ever held by the reader. A
record whose bytes or digest aren't the declared ones is an error.

Hot payloads. The rows of one payload are dealt to as many salts as a table of its size needs, and only the least
page_id of each salt meets the others; rows that repeat page_id and url as well share a salt, and are split by
adaptive execution only.

A null html is an empty payload, a null url an empty one; line breaks in a url are percent-encoded. Null
page_ids come after all others (a group with none else has null for its response). Rows that repeat the
smallest page_id are responses too. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_folder
from .common import arrow_batches, text_or_empty

URN = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
WRITE_BYTES = 1 << 16

CHUNKS = (
    "path string, record_no long, page_id long, url string, record_type string, refers_to long, "
    "declared_digest string, declared_bytes long, chunk_no int, n_bytes long, digest_so_far string, data binary"
)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: each five hex digits make four base32 digits."""
    digits = F.sha1(payload)
    four = [F.lpad(F.conv(F.substring(digits, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.upper(F.concat(*four)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def assign_records(pages: DataFrame, html: str = "html", min_revisit_bytes: int = 0, rows_per_salt: int = 20_000) -> DataFrame:
    """page_id, url, payload, digest, first: the page_id of the response with this payload.

    The least page_id of a digest is combined before the shuffle, and handed to the salts that the digest's own
    rows use, so copies of one payload don't meet in one task: about rows_per_salt of them do, however many there are.
    """
    salts = max(16, pages.count() // rows_per_salt)
    payload = text_or_empty(html).cast("binary")
    dealt = F.xxhash64("page_id", text_or_empty("url"))
    salt = F.when(F.length(payload) >= min_revisit_bytes, F.pmod(dealt, F.lit(salts))).otherwise(-1 - F.pmod(dealt, F.lit(1 << 62)))
    rows = pages.select("page_id", text_or_empty("url").alias("url"), payload.alias("payload"), base32_sha1(payload).alias("digest"), salt.alias("salt"))
    alone = F.col("salt") < 0
    some = rows.filter(~alone).groupBy("digest", "salt").agg(F.min("page_id").alias("least"))
    least = some.groupBy("digest").agg(F.min("least").alias("first"))
    known = some.select("digest", "salt").join(least, "digest")
    return rows.join(known, ["digest", "salt"], "left").withColumn("first", F.when(alone, F.col("page_id")).otherwise(F.col("first"))).drop("salt")


def _record(page_id: int | None, url: str, payload: bytes, digest: str, first: int | None) -> Iterator[bytes]:
    """The bytes of one record, in pieces."""
    name = lambda x: f"<{URN}{'' if x is None else x}>"
    revisit = page_id != first
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(first)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else len(payload))}",
    ]
    yield "\r\n".join(head).encode() + b"\r\n\r\n" + http
    if not revisit:
        view = memoryview(payload)
        for k in range(0, len(payload), WRITE_BYTES):
            yield bytes(view[k : k + WRITE_BYTES])
    yield b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write the rows of ``assign_records`` into folder (a URI all executors reach): path and records of each archive."""
    arrow_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        path, count, out = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            columns = [batch.column(k) for k in range(5)]
            for k in range(batch.num_rows):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                for piece in _record(*(c[k].as_py() for c in columns)):
                    out.write(member.compress(piece))
                out.write(member.flush())
                count += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([count], pa.int64())})

    columns = records.select("page_id", "url", "payload", "digest", "first")
    return cut_lineage(columns.mapInArrow(run, "path string, records long"))


def _header(lines: Iterator[bytes]) -> dict[str, str]:
    found = {}
    for line in lines:
        if line in (b"\r\n", b""):
            break
        key, _, value = line.decode().partition(":")
        found[key.strip().lower()] = value.strip()
    return found


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix(f"<{URN}").removesuffix(">")
    return int(digits) if digits else None


def stream_records(source, chunk_bytes: int) -> Iterator[tuple]:
    """The chunk rows of one archive, from a file object, without the path."""
    record_no = 0
    while source.readline():  # WARC/1.1
        head = _header(iter(source.readline, None))
        left = int(head["content-length"])
        source.readline()  # the status line
        http, used = {}, len(b"HTTP/1.1 200 OK\r\n")
        while (line := source.readline()) not in (b"\r\n", b""):
            used += len(line)
            key, _, value = line.decode().partition(":")
            http[key.strip().lower()] = value.strip()
        left -= used + 2
        kind = head["warc-type"]
        row = (
            record_no, _page(head["warc-record-id"]), head["warc-target-uri"], kind, _page(head.get("warc-refers-to")),
            head["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"]),
        )
        digest, chunk_no = hashlib.sha1(), 0
        while left > 0 or chunk_no == 0:
            data = source.read(min(left, chunk_bytes))
            if len(data) < min(left, chunk_bytes):
                raise EOFError(f"record {record_no} ends early")
            digest.update(data)
            left -= len(data)
            yield (*row, chunk_no, len(data), base64.b32encode(digest.digest()).decode(), data)
            chunk_no += 1
        source.readline(), source.readline()
        record_no += 1


def read_archives(archives: DataFrame, folder: str, chunk_bytes: int = 1 << 15) -> DataFrame:
    """The chunk table of the archives that ``write_archives`` listed."""
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[c.split()[1]]) for n, c in zip(names, CHUNKS.split(", "))])

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                with store.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as source:
                    for row in stream_records(source, chunk_bytes):
                        held.append((path, *row))
                        size += row[-3]
                        if size > 4 * chunk_bytes or len(held) >= 2000:
                            yield table_of(held)
                            held, size = [], 0
                if held:
                    yield table_of(held)

    return archives.select("path").mapInArrow(run, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row a record: its payload's length and digest, from the chunks of responses, as declared for revisits."""
    own = F.col("record_type") == "response"
    same = [F.first(c).alias(c) for c in ("page_id", "url", "record_type", "refers_to", "declared_digest", "declared_bytes")]
    whole = chunks.groupBy("path", "record_no").agg(
        *same,
        F.sum(F.length("data")).cast("long").alias("read_bytes"),
        F.max_by("digest_so_far", "chunk_no").alias("read_digest"),
        (F.count("*") - F.max("chunk_no")).alias("complete"),
    )
    intact = (F.col("read_digest") == F.col("declared_digest")) & (F.col("read_bytes") == F.col("declared_bytes")) & (F.col("complete") == 1)
    broken = F.raise_error(F.concat_ws(" ", F.lit("broken record"), "record_no", F.lit("of"), "path"))
    return whole.select(
        "page_id",
        "url",
        F.when(own, F.when(intact, F.col("read_bytes")).otherwise(broken.cast("long"))).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(own, F.col("read_digest")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def archive_pages(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0) -> tuple[DataFrame, str]:
    """Write pages (page_id, url, html) to a new folder: the list of archives and the folder."""
    folder = shared_folder(spark, "warc")
    return write_archives(assign_records(pages, min_revisit_bytes=min_revisit_bytes), folder), folder
