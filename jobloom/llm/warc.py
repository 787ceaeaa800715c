"""WARC archives by way of a chunked record table.

A payload of any size is a run of rows (record, chunk_no, data) of at most
``CHUNK`` bytes.  Everything that touches payloads streams over such rows and
carries what it knows of the open record (digests, length, the compressor)
from one to the next, so no Python process ever holds a whole record:

1. ``payload_digests`` splits payloads and digests each (SHA-1 of the payload
   and of the record's block, SHA-256 as the key of equality), without a shuffle;
2. ``record_types`` finds the response of each set of equal payloads: partial
   minima first, and groups that hold a thousandth of all rows, at most a
   thousand of them, are joined by broadcast, so a hot payload is not one task;
3. ``write_warc`` joins headers to payloads once, splits these again and streams
   them into gzip members, one a record; a file is closed after ``FILE_BYTES``;
4. ``read_warc`` streams files back into chunk rows, and ``read_records`` digests
   them, compares with the headers and fails where they differ.

Defined results: a null payload is empty; equal payloads have one response, the
row of the smallest id (null ids last), and among rows of that id one, so
repeated rows are revisits of their own id; payloads below ``least`` bytes are
all responses; a null id is read back as null, and a revisit of one refers to
null; a null URL becomes a URN of the id; an empty table writes no file and
reads as no rows; very long payloads are streamed; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm._shared import in_small_batches
from jobloom.storage import discard, materialize, scratch_path

CHUNK = 1 << 14
FILE_BYTES = 1 << 30
READ_BYTES = 1 << 18
#: A head that is longer than this is not one.
HEAD_BYTES = 1 << 20
#: Groups of at least one in so many rows are joined by broadcast; there are at most so many of them.
HOT_SHARE = 1000
# Fixed values of WARC 1.1.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Archive(NamedTuple):
    path: str
    n_records: int


def http_head(n_bytes: int) -> bytes:
    """The response head that stands before a payload in its record's block."""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_urn(page: str | None, rec: int) -> str:
    """A record's name: the same whenever a task writes it again."""
    return uuid.UUID(bytes=hashlib.sha256(f"{page}:{rec}".encode()).digest()[:16], version=5).urn


# ---------------------------------------------------------------- chunk rows


def chunk_rows(rows: DataFrame, payload: Column, *kept: Column | str) -> DataFrame:
    """(kept columns, chunk_no, last, data): each payload as rows of ``CHUNK`` bytes in order, an empty one as one row."""
    whole = rows.select(*kept, F.coalesce(payload.cast("binary"), F.lit(b"")).alias("_p"))
    last = F.greatest(F.ceil(F.octet_length("_p") / CHUNK).cast("int") - 1, F.lit(0))
    names = whole.columns[:-1]
    numbered = whole.select(*names, "_p", last.alias("_last"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    data = F.expr(f"substring(_p, chunk_no * {CHUNK} + 1, {CHUNK})")
    return numbered.select(*names, "chunk_no", (F.col("chunk_no") == F.col("_last")).alias("last"), data.alias("data"))


class Digests:
    """Digests of a payload that comes in chunks."""

    def __init__(self, n_bytes: int):
        self.sha1, self.key, self.block, self.n = hashlib.sha1(), hashlib.sha256(), hashlib.sha1(http_head(n_bytes)), 0

    def add(self, data: bytes) -> None:
        self.n += len(data)
        for h in (self.sha1, self.key, self.block):
            h.update(data)


def payload_digests(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(rec, page_id, url, payload_bytes, digest, block_digest, key), a row a page; written, so ``rec`` stays."""
    size = F.coalesce(F.octet_length(payload_col), F.lit(0)).cast("bigint")
    rows = chunk_rows(pages, F.col(payload_col), F.monotonically_increasing_id().alias("rec"), F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), size.alias("payload_bytes"))
    schema = f"rec bigint, page_id {rows.schema['page_id'].dataType.simpleString()}, url string, payload_bytes bigint, digest string, block_digest string, key binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, names = Digests(0), ["rec", "page_id", "url", "payload_bytes"]
        for batch in batches:
            sizes, chunk_no, last, data = (batch.column(k) for k in (3, 4, 5, 6))
            ends, found = [], []
            for i, (n, no, end) in enumerate(zip(sizes.to_pylist(), chunk_no.to_pylist(), last.to_pylist(), strict=True)):
                if no == 0:
                    open_ = Digests(n)
                open_.add(data[i].as_py())
                if end:
                    ends.append(i)
                    found.append((base32(open_.sha1.digest()), base32(open_.block.digest()), open_.key.digest()))
            kept = batch.select(names).take(pa.array(ends, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.binary())))], [*names, "digest", "block_digest", "key"])

    return materialize(in_small_batches(rows).mapInArrow(run, schema), "payloads")


def record_types(digests: DataFrame, least: int = 0) -> DataFrame:
    """``digests`` with ``to``, the (page_id, rec, url) of the response that a revisit refers to; null for responses.

    Of equal payloads the least (null id last, id, rec) is the response.
    """
    n = digests.count()
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "rec", "url"))
    groups = digests.filter(F.col("payload_bytes") >= least).groupBy("key").agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = materialize(groups, "payload-groups")
    hot = F.col("n") * HOT_SHARE >= n
    near = digests.join(F.broadcast(groups.filter(hot).select("key", "first")), "key", "left")  # at most HOT_SHARE groups
    rest = near.filter("first is null").drop("first").join(groups.filter(~hot).select("key", "first"), "key", "left")
    both = near.filter("first is not null").unionByName(rest)
    to = F.when(F.col("first.rec") != F.col("rec"), F.struct("first.page_id", "first.rec", "first.url"))
    out = materialize(both.select(*digests.columns, to.alias("to")), "payload-types")
    discard(groups)
    return out


# ---------------------------------------------------------------- writing


def _uri(url: str | None, page: str | None) -> str:
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{quote(page or '', safe='')}"


def warc_head(kind: str, urn: str, date: str, length: int, fields: list[tuple[str, str]]) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{urn}>", f"WARC-Date: {date}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


class ArchiveWriter:
    """Writes records into one file as they come: a gzip member each, compressed chunk by chunk."""

    def __init__(self, stream, date: str, level: int):
        self.stream, self.date, self.level, self.n_bytes, self.n_records, self.zip = stream, date, level, 0, 0, None
        body = b"software: jobloom\r\nformat: WARC File Format 1.1\r\n"
        self.open(warc_head("warcinfo", record_urn(None, -1), date, len(body), [("Content-Type", "application/warc-fields")]))
        self.add(body)
        self.close()
        self.n_records = 0

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.n_bytes += len(data)

    def open(self, head: bytes) -> None:
        self.zip = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        self.add(head)

    def add(self, data: bytes) -> None:
        self._put(self.zip.compress(data))

    def close(self) -> None:
        self._put(self.zip.compress(b"\r\n\r\n") + self.zip.flush())
        self.n_records += 1

    def start(self, x: dict) -> None:
        """Open a page's record and write what stands before its payload."""
        page = None if x["page"] is None else str(x["page"])
        head, to = http_head(x["payload_bytes"]), x["to"]
        fields = [("WARC-Target-URI", _uri(x["url"], page)), ("WARC-Payload-Digest", f"sha1:{x['digest']}"), ("Content-Type", "application/http; msgtype=response")]
        if page is not None:
            fields.append(("WARC-Page-Id", quote(page, safe="")))
        if to is None:
            fields.append(("WARC-Block-Digest", f"sha1:{x['block_digest']}"))
            self.open(warc_head("response", record_urn(page, x["rec"]), self.date, len(head) + x["payload_bytes"], fields) + head)
            return
        first = None if to["page"] is None else str(to["page"])
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{record_urn(first, to['rec'])}>"), ("WARC-Refers-To-Target-URI", _uri(to["url"], first))]
        if first is not None:
            fields.append(("WARC-Refers-To-Page-Id", quote(first, safe="")))
        self.open(warc_head("revisit", record_urn(page, x["rec"]), self.date, len(head), fields) + head)


def write_warc(pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 6, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> list[Archive]:
    """Write a record a row below ``path``; returns the files, a gigabyte each, so what the driver holds is bounded by their number.

    A task writes under a name of its own and renames what is whole, so a
    retried one leaves no half-written archive.
    """
    digests = payload_digests(pages, id_col, url_col, payload_col)
    typed = record_types(digests, least)
    discard(digests)
    # rows of one id and payload are alike: they share one copy of it, and only a response's is written
    place = lambda page, key: F.concat_ws(":", F.hex(key), page.cast("string"))
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    payloads = pages.select(place(F.col(id_col), F.unhex(F.sha2(payload, 256))).alias("place"), payload.alias("payload")).dropDuplicates(["place"])
    records = typed.withColumn("place", place(F.col("page_id"), F.col("key"))).join(payloads, "place")
    page = F.col("page_id").cast("string").alias("page")
    to = F.when(F.col("to").isNotNull(), F.struct(F.col("to.page_id").cast("string").alias("page"), "to.rec", "to.url")).alias("to")
    rows = chunk_rows(records, F.when(F.col("to").isNull(), F.col("payload")), "rec", page, "url", "payload_bytes", "digest", "block_digest", to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        target, base = fs.FileSystem.from_uri(path)
        target.create_dir(base)
        writer, done = None, []

        def close() -> None:
            nonlocal writer
            writer.stream.close()
            name = f"part-{part:06d}-{len(done):04d}.warc.gz"
            target.move(f"{base}/.{name}.{attempt}", f"{base}/{name}")
            done.append({"part": part, "k": len(done), "name": name, "n_records": writer.n_records})
            writer = None

        for batch in batches:
            heads, data = batch.drop_columns(["data"]).to_pylist(), batch.column("data")
            for i, x in enumerate(heads):
                if writer is None:
                    stream = target.open_output_stream(f"{base}/.part-{part:06d}-{len(done):04d}.warc.gz.{attempt}", compression=None)
                    writer = ArchiveWriter(stream, date, level)
                if x["chunk_no"] == 0:
                    writer.start(x)
                writer.add(data[i].as_py())
                if x["last"]:
                    writer.close()
                    if writer.n_bytes >= FILE_BYTES:
                        close()
        if writer is not None:
            close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("part", pa.int64()), ("k", pa.int64()), ("name", pa.string()), ("n_records", pa.int64())]))

    made = in_small_batches(rows).mapInArrow(run, "part long, k long, name string, n_records long").collect()
    discard(typed)
    return [Archive(f"{path}/{r.name}", r.n_records) for r in sorted(made, key=lambda r: (r.part, r.k))]


# ---------------------------------------------------------------- reading


class ArchiveReader:
    """Streams a gzip-per-record file: heads are parsed, payloads come in chunks."""

    def __init__(self, source):
        self.source, self.packed, self.buffer, self.zip = source, b"", bytearray(), zlib.decompressobj(31)

    def _fill(self) -> bool:
        """At least one more byte in the buffer, unless the file has ended."""
        have = len(self.buffer)
        while len(self.buffer) == have:
            if not self.packed:
                self.packed = self.source.read(READ_BYTES)
                if not self.packed:
                    return False
            if self.zip.eof:
                self.zip = zlib.decompressobj(31)
            self.buffer += self.zip.decompress(self.packed, READ_BYTES)
            self.packed = self.zip.unused_data if self.zip.eof else self.zip.unconsumed_tail
        return True

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._fill():
                raise ValueError("an archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def head(self) -> tuple[str, dict[str, str], int]:
        """(first line, fields by lower-case name, bytes) up to the empty line."""
        while (at := self.buffer.find(b"\r\n\r\n")) < 0:
            if len(self.buffer) > HEAD_BYTES or not self._fill():
                raise ValueError("no end of a record's head")
        first, *lines = self.take(at + 4)[:-4].decode("utf-8").split("\r\n")
        return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, at + 4

    def records(self) -> Iterator[tuple[dict[str, str], int, Iterator[bytes]]]:
        """(fields, payload bytes by its HTTP head, payload chunks) of each page record; the chunks must be read before the next one."""
        while self.buffer or self._fill():
            version, fields, _ = self.head()
            if not version.startswith("WARC/"):
                raise ValueError(f"no WARC record: {version[:40]!r}")
            left, size = int(fields["content-length"]), 0
            http = fields.get("content-type", "").startswith("application/http")
            if http:
                _, inner, n = self.head()
                left, size = left - n, int(inner.get("content-length", left - n))
            if fields["warc-type"] in ("response", "revisit"):
                yield fields, size, self._chunks(left)
            else:
                for _ in self._chunks(left):
                    pass
            if self.take(4) != b"\r\n\r\n":
                raise ValueError("a record is longer than it says")

    def _chunks(self, left: int) -> Iterator[bytes]:
        """At most CHUNK bytes at a time; one empty chunk for an empty payload."""
        yield self.take(min(CHUNK, left))
        left -= CHUNK
        while left > 0:
            yield self.take(min(CHUNK, left))
            left -= CHUNK


def _files(spark: SparkSession, files: list[Archive]) -> DataFrame:
    each = spark.createDataFrame([(k, f.path) for k, f in enumerate(files)], "k long, path string")
    return each.repartitionByRange(max(1, len(files)), "k")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, ArchiveReader]]:
    for batch in batches:
        for path in batch.column(1).to_pylist():
            source, name = fs.FileSystem.from_uri(path)
            with source.open_input_stream(name, compression=None) as f:
                yield path, ArchiveReader(f)


def read_warc(spark: SparkSession, files: list[Archive]) -> DataFrame:
    """(path, record, chunk_no, fields, data): archives as a chunked record table; ``fields`` (the head) in chunk 0 only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for path, reader in _opened(batches):
            for n, (fields, _, chunks) in enumerate(reader.records()):
                for no, data in enumerate(chunks):
                    out.append((path, n, no, None if no else list(fields.items()), data))
                    if len(out) == 512:
                        yield rows(out)
                        out = []
        if out:
            yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["path", "record", "chunk_no", "fields", "data"])

    return _files(spark, files).mapInArrow(run, "path string, record bigint, chunk_no bigint, fields map<string,string>, data binary")


def read_records(spark: SparkSession, files: list[Archive]) -> DataFrame:
    """(page, url, payload_bytes, payload_digest, record_type, refers_to): a row a record, digests computed anew from its chunks.

    A response whose payload or block differs from its head raises ValueError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for path, reader in _opened(batches):
            for fields, size, chunks in reader.records():
                found = Digests(size)
                for data in chunks:
                    found.add(data)
                said, page, to = fields["warc-payload-digest"].removeprefix("sha1:"), fields.get("warc-page-id"), fields.get("warc-refers-to-page-id")
                if fields["warc-type"] == "response" and (found.n, base32(found.sha1.digest()), f"sha1:{base32(found.block.digest())}") != (size, said, fields["warc-block-digest"]):
                    raise ValueError(f"digest of record {fields['warc-record-id']} of {path} differs")
                out.append((None if page is None else unquote(page), fields["warc-target-uri"], size, said, fields["warc-type"], None if to is None else unquote(to)))
                if len(out) == 4096:
                    yield rows(out)
                    out = []
        if out:
            yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        names = ("page", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64() if k == 2 else pa.string()) for k in range(6)], list(names))

    return _files(spark, files).mapInArrow(run, "page string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")


def warc_digest(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    files = write_warc(pages, scratch_path(spark, "warc"))
    kind = pages.schema["page_id"].dataType
    return read_records(spark, files).select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p"""
