"""Content-addressed web archive.

``parse`` cuts the bytes of an archive file into records: an exact header block (the record's own header and, for an HTTP
message, that message's header), a payload and what stands between it and the next record. ``archive`` splits records into
``headers`` (one row a record, with the payload's SHA-256) and ``payloads`` (one row a digest, checked against length and a
second hash of every record). ``reconstruct`` joins them again, byte for byte.

Defined cases: a null payload has a null digest, takes no row in ``payloads`` and is rebuilt as null; an empty payload
is a payload like any other; a null header is rebuilt as null; repeated rows stay repeated; empty tables give empty
tables; further columns are left out, whatever their names. Bytes that are no record, and a record that the file cuts
short or that states no length, become a record of kind null up to the next record, so nothing of a file is lost; a
stated SHA-1 that the bytes do not have gives ``stated_ok`` false, one that is missing or of another kind null. A page
without markup gives a record with an empty payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

CRLF = "\r\n"
FIXED_DATE = "2020-01-01T00:00:00Z"
MAGIC = re.compile(rb"WARC/\d+\.\d+\r?\n")
END = re.compile(rb"\r?\n\r?\n")
CHUNK = 1 << 20
SCHEMA = "kind string, url string, header binary, payload binary, tail binary, stated_ok boolean"
ROW = tuple[str | None, str | None, bytes, bytes | None, bytes, bool | None]


def fields(block: bytes) -> dict[str, str]:
    """Header fields by name in lower case, the first of each; lines that begin with white space go on the one before."""
    out: dict[str, str] = {}
    lines = re.sub(rb"\r?\n[ \t]+", b" ", block).split(b"\n")
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _stated(digest: str | None, data: bytes) -> bool | None:
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1" or not value:
        return None
    made = hashlib.sha1(data).digest()
    return value.lower() == made.hex() or value.upper() == base64.b32encode(made).decode()


def parse(file: BinaryIO) -> Iterator[ROW]:
    """Records (kind, url, header, payload, tail, stated_ok) of a stream, one after the other; one record is held at a time."""
    held, done = b"", False

    def more() -> None:
        nonlocal held, done
        part = file.read(max(CHUNK, len(held)))  # doubling, so a long record is copied a few times only
        done, held = not part, held + part

    def junk() -> ROW:
        """Up to the next record, from the second byte on."""
        nonlocal held
        at = 1
        while True:
            found = MAGIC.search(held, at)
            if found or done:
                end = found.start() if found else len(held)
                row = (None, None, held[:end], None, b"", None)
                held = held[end:]
                return row
            at = max(1, len(held) - 32)
            more()

    more()
    while held or not done:
        while len(held) < 32 and not done:
            more()
        if not held:
            return
        head = END.search(held) if MAGIC.match(held) else None
        while MAGIC.match(held) and head is None and not done:
            at = max(0, len(held) - 4)
            more()
            head = END.search(held, at)
        said = fields(held[: head.end()]) if head else {}
        length = said.get("content-length", "")
        if not head or not length.isdigit():
            yield junk()
            continue
        stop = head.end() + int(length)
        while len(held) < stop and not done:
            more()
        if len(held) < stop:
            yield junk()
            continue
        block = held[head.end() : stop]
        inner = END.search(block) if said.get("content-type", "").lower().startswith("application/http") else None
        split = inner.end() if inner else 0
        after = stop
        while True:
            while after < len(held) and held[after] in b"\r\n":
                after += 1
            if after < len(held) or done:
                break
            more()
        oks = [_stated(said.get("warc-block-digest"), block), _stated(said.get("warc-payload-digest"), block[split:])]
        known = [ok for ok in oks if ok is not None]
        yield said.get("warc-type"), said.get("warc-target-uri"), held[: head.end() + split], block[split:], held[stop:after], all(known) if known else None
        held = held[after:]


class _Bytes:
    """A byte string as a stream that is read once and whole."""

    def __init__(self, data: bytes):
        self.data = data

    def read(self, _: int) -> bytes:
        data, self.data = self.data, b""
        return data


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


_KINDS = [pa.string(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def parsed(rows: DataFrame, key: str = "record_id", data: str = "data") -> DataFrame:
    """Records (record_id, part, ...) of archive bytes held in a column; a value can hold several records. Null bytes give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 200):
            out = [(k.as_py(), i, *r) for k, d in zip(piece.column(0), piece.column(1)) if d.is_valid for i, r in enumerate(parse(_Bytes(d.as_py())))]
            yield _batch(out, ["record_id", "part", *_NAMES], [pa.int64(), pa.int32(), *_KINDS])

    return rows.select(rows[key].cast("bigint").alias("record_id"), rows[data].alias("data")).mapInArrow(run, f"record_id bigint, part int, {SCHEMA}")


def read(spark: SparkSession, paths: str | list[str], batch_bytes: int = 8 << 20) -> DataFrame:
    """Records (path, part, ...) of archive files, plain or gzip (a member a record, or all in one).

    A task streams a file and holds one batch of records. Paths come from the file listing; the contents are not loaded
    through it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["path", "part", *_NAMES], [pa.string(), pa.int64(), *_KINDS]
        for path in (p.as_py() for batch in batches for p in batch.column(0)):
            fs, at = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
            with fs.open_input_stream(at, compression=None) as raw:
                rows, size = [], 0
                for i, row in enumerate(parse(gzip.GzipFile(fileobj=raw) if at.endswith(".gz") else raw)):
                    rows.append((path, i, *row))
                    size += len(row[2]) + len(row[3] or b"")
                    if size >= batch_bytes:
                        yield _batch(rows, names, kinds)
                        rows, size = [], 0
                yield _batch(rows, names, kinds)

    files = spark.read.format("binaryFile").load(paths).select("path")
    return files.repartition("path").mapInArrow(run, f"path string, part bigint, {SCHEMA}")


def wire(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(record_id, data): crawled pages as the bytes of response records, for tables that hold no archive."""
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    payload = F.coalesce(pages[body].cast("binary"), F.lit("").cast("binary"))
    size = F.octet_length(payload)
    http = text("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html" + CRLF + "Content-Length: ", size.cast("string"), CRLF * 2)
    header = text(
        "WARC/1.0" + CRLF + "WARC-Type: response" + CRLF + "WARC-Record-ID: <urn:page:", F.coalesce(pages[key].cast("string"), F.lit("")),
        ">" + CRLF + "WARC-Date: " + FIXED_DATE + CRLF + "WARC-Target-URI: ", F.coalesce(F.regexp_replace(pages[url], r"[\r\n]", ""), F.lit("")),
        CRLF + "Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: ", (F.octet_length(http) + size).cast("string"), CRLF * 2,
    )
    return pages.select(pages[key].alias("record_id"), F.concat(header.cast("binary"), http.cast("binary"), payload, F.lit(CRLF * 2).cast("binary")).alias("data"))


def archive(recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads) of records.

    ``payloads`` keeps the bytes of each digest once. The aggregate combines on the map side, so a payload that is
    everywhere crosses the network once for each map task. ``verified`` says that the bytes kept hash to their
    digest, and that every record of that digest agreed on length and on a second, independent hash.
    """
    own = [c for c in recs.columns if c in ("record_id", "path", "part", "kind", "url", "header", "tail", "stated_ok")]
    keyed = recs.select(*own, F.sha2("payload", 256).alias("digest"), "payload")
    payloads = (
        keyed.where(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(
            F.first("payload").alias("payload"), F.count("*").alias("copies"),
            F.min(F.struct(F.octet_length("payload"), F.xxhash64("payload"))).alias("lo"),
            F.max(F.struct(F.octet_length("payload"), F.xxhash64("payload"))).alias("hi"),
        )
        .select(
            "digest", "payload", "copies",
            ((F.col("lo") == F.col("hi")) & (F.sha2("payload", 256) == F.col("digest"))).alias("verified"),
        )
    )
    return keyed.drop("payload"), payloads


def reconstruct(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """The original records: the columns of ``headers`` with payload, copies and verified."""
    held = payloads.select(F.col("digest").alias("_digest"), "payload", "copies", "verified")
    return headers.join(held, F.col("digest") == F.col("_digest"), "left").drop("_digest")


def record_bytes() -> Column:
    """The record as it stands in a file: header block, payload, what ends it."""
    return F.concat(F.col("header"), F.coalesce(F.col("payload"), F.lit("").cast("binary")), F.col("tail"))


def rebuilt(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as records, parse and archive them, rebuild every record and report its digests and sizes."""
    back = reconstruct(*archive(parsed(wire(pages)).select("record_id", "kind", "url", "header", "payload", "tail")))
    return back.select(
        F.col("record_id").alias("page_id"), "kind", F.col("digest").alias("payload_digest"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.octet_length("header").cast("bigint").alias("header_bytes"),
        F.col("copies").cast("bigint").alias("copies"), F.coalesce("verified", F.lit(True)).alias("verified"),
        F.sha2(record_bytes(), 256).alias("record_digest"),
    )


SQL = """
WITH h AS (
  SELECT page_id, url, coalesce(html, '') AS html, concat('HTTP/1.1 200 OK', chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10),
    'Content-Length: ', CAST(strlen(coalesce(html, '')) AS VARCHAR), chr(13), chr(10), chr(13), chr(10)) AS http
  FROM pages),
r AS (
  SELECT page_id, html, sha256(html) AS payload_digest,
    concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:page:',
           coalesce(CAST(page_id AS VARCHAR), ''), '>', chr(13), chr(10), 'WARC-Date: 2020-01-01T00:00:00Z', chr(13), chr(10),
           'WARC-Target-URI: ', regexp_replace(coalesce(url, ''), '[\\r\\n]', '', 'g'), chr(13), chr(10), 'Content-Type: application/http; msgtype=response', chr(13), chr(10),
           'Content-Length: ', CAST(strlen(http) + strlen(html) AS VARCHAR), chr(13), chr(10), chr(13), chr(10), http) AS header
  FROM h)
SELECT page_id, 'response' AS kind, payload_digest, CAST(strlen(html) AS BIGINT) AS payload_bytes, CAST(strlen(header) AS BIGINT) AS header_bytes,
  count(*) OVER (PARTITION BY payload_digest) AS copies, true AS verified,
  sha256(concat(header, html, chr(13), chr(10), chr(13), chr(10))) AS record_digest
FROM r
"""
