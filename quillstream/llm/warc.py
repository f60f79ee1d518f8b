"""WARC archives compressed record by record with a dictionary of their own.

An archive starts with a skippable Zstandard frame that embeds the dictionary;
each record then is one Zstandard frame, so any record can be read alone. Spark
deals pages to tasks, a task writes archives into the shared folder, and a
manifest names the archives of the tasks that succeeded.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.kernels import texts_of, tidy
from quillstream.llm.shared import fresh_path, project, stage_table

#: Magic number of the skippable frame that holds a dictionary, as the format for Zstandard WARC files has it.
SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES = 32 << 10
#: A dictionary is trained on records evenly spread over its archive, up to so many bytes.
TRAINING_BYTES = 100 * DICTIONARY_BYTES
ARCHIVE_BYTES = 32 << 20
LEVEL = 3
#: Shorter payloads are never revisits.
LEAST_REVISIT = 1000
CRLF = b"\r\n"


def train_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from archived records; the records' own bytes where there are too few to train on."""
    total = sum(map(len, records))
    step = max(1, -(-total // TRAINING_BYTES))
    sample = [r[: 64 << 10] for r in records[::step]] or [b""]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICTIONARY_BYTES]


def header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1" + CRLF + b"".join(f"{k}: {v}".encode() + CRLF for k, v in fields) + CRLF


def clean(value: str | None) -> str:
    """A header value: line ends cannot stand in it and are written as %0D and %0A."""
    return (value or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, kind: str, refers_to: tuple[int | None, str | None] | None, digest: str, size: int, payload: bytes, date: str) -> bytes:
    """A WARC/1.1 record with an id of its own. Its block is an HTTP message: the head alone for a revisit, which
    names the URL and date of what it repeats. page_id and size stand in fields that are no part of the format."""
    head = b"HTTP/1.1 200 OK" + CRLF + b"Content-Type: text/html; charset=utf-8" + CRLF + f"Content-Length: {size}".encode() + CRLF + CRLF
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", uuid.uuid4().urn.join("<>")),
        ("WARC-Date", date),
        ("WARC-Target-URI", clean(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Bytes", str(size)),
    ]
    if kind == "revisit":
        page, target = refers_to
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", clean(target)),
            ("WARC-Refers-To-Date", date), ("X-Refers-To-Page", "" if page is None else str(page)),
        ]
        payload = b""
    block = head + payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return header(fields) + block + CRLF + CRLF


def compress(records: list[bytes]) -> Iterator[bytes]:
    """An archive: the dictionary's frame, then a frame for each record."""
    raw = train_dictionary(records)
    yield struct.pack("<II", SKIPPABLE, len(raw)) + raw
    codec = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_content_size=True)
    for r in records:
        yield codec.compress(r)


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, payload) of each record of an open archive, one record at a time; the HTTP head is no part of a payload."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive does not start with a dictionary")
    raw = source.read(size)
    codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    pending, part = b"", None
    while True:
        if part is None:
            pending = pending or source.read(1 << 20)
            if not pending:
                return
            part, pieces = codec.decompressobj(), []
        if not pending:
            pending = source.read(1 << 20)
            if not pending:
                raise ValueError("the archive ends within a record")
        pieces.append(part.decompress(pending))
        pending = b""
        if part.eof:
            pending, part = part.unused_data, None
            head, _, rest = b"".join(pieces).partition(CRLF + CRLF)
            lines = head.decode().split("\r\n")
            fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
            yield fields, rest[: int(fields["Content-Length"])].partition(CRLF + CRLF)[2]


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, html, sha1, n_bytes, record_type, refers_to, refers_url) and return the manifest (path, records).

    A task writes each archive under a name of its own and only then names it in
    the manifest, so what a lost or repeated task left behind is never read.
    """

    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")  # of the archives, whichever task writes

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            store, at = open_fs(path)
            store.create_dir(at.rpartition("/")[0], recursive=True)
            with store.open_output_stream(at, compression=None) as out:
                for frame in compress(held):
                    out.write(frame)
            n = len(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

        for batch in batches:
            html = texts_of(batch.column("html")).cast(pa.large_binary()).to_pylist()
            other = (batch.column(c).to_pylist() for c in ("page_id", "url", "record_type", "refers_to", "refers_url", "sha1", "n_bytes"))
            for payload, (page_id, url, kind, refers, target, sha1, n) in zip(html, zip(*other, strict=True), strict=True):
                one = record(page_id, url, kind, (refers, target), sha1, n, payload, date)
                held.append(one)
                size += len(one)
                if size >= archive_bytes:
                    size = 0
                    yield flush()
        if held:
            yield flush()

    columns = ("page_id", "url", "html", "sha1", "n_bytes", "record_type", "refers_to", "refers_url")
    return stage_table(pages.select(*columns).mapInArrow(tidy(write), "path string, records bigint"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Rows (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of all archives.

    The digest of a response is computed anew from the payload that was read and
    has to equal the one in its header; a revisit has that of the record it refers to.
    """

    def number(value: str) -> int | None:
        return int(value) if value else None

    def plain(value: str) -> str:
        return value.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = open_fs(path)
                rows: list[tuple] = []
                size = 0
                with store.open_input_stream(at, compression=None) as source:
                    for fields, payload in read_archive(source):
                        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        n = int(fields["X-Payload-Bytes"])
                        if kind == "response":
                            if hashlib.sha1(payload, usedforsecurity=False).hexdigest() != digest or len(payload) != n:
                                raise ValueError(f"a record in {path} does not fit its digest")
                        refers = number(fields["X-Refers-To-Page"]) if kind == "revisit" else None
                        rows.append((number(fields["X-Page-ID"]), plain(fields["WARC-Target-URI"]), n, digest, kind, refers, payload))
                        size += len(payload)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(parts, "path").mapInArrow(
        tidy(read),
        "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary",
    )


def archive_pages(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archive every page and return what read_archives finds in the archives.

    The payload is the html in UTF-8, null is an empty one. Of records with equal
    payloads of at least 1000 bytes, the one with the largest page_id is the response
    and the others revisit it; smaller ones are all responses. A null page_id is
    smaller than any other and stays null. Of rows that repeat the largest page_id
    and its payload, all are responses. A null url is written as an empty one. No
    rows make no archive. Other columns are not read. Payloads are equal when their SHA-256 is;
    bytes are not compared. Dictionaries are trained on a bounded sample of an archive's records, of which
    each gives its first 64 KiB at most; the records themselves are archived whole.
    """
    rows = project(pages, page_id="bigint", url="string", html="string")
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = rows.select("page_id", "url", "html", F.sha1(body).alias("sha1"), F.sha2(body, 256).alias("__sha"), F.length(body).cast("bigint").alias("n_bytes"))
    groups = (
        rows.where(F.col("n_bytes") >= LEAST_REVISIT)
        .groupBy("__sha")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "url")).alias("newest"))
        .where("n > 1")
        .select("__sha", F.col("newest.page_id").alias("newest"), F.col("newest.url").alias("newest_url"))
    )
    groups = stage_table(groups, "warc-groups")
    again = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    rows = rows.join(groups, "__sha", "left").select(
        "page_id", "url", "html", "sha1", "n_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("newest")).alias("refers_to"),
        F.when(again, F.col("newest_url")).alias("refers_url"),
    )
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(rows, folder, archive_bytes))


ORACLE_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n_bytes
  from pages),
r as (
  select *, max(page_id) over (partition by html) as newest from p)
select page_id, n_bytes::bigint as payload_bytes, sha1(html) as payload_digest,
  case when n_bytes >= 1000 and page_id <> newest then 'revisit' else 'response' end as record_type,
  case when n_bytes >= 1000 and page_id <> newest then newest end as refers_to
from r"""
