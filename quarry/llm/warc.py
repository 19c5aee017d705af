"""WARC writing and reading over a chunked record table.

A payload travels as rows (record, chunk number, chunk), so no step holds a whole record: the writer compresses chunk
after chunk into one gzip member per record, the reader inflates members in pieces and yields a row per chunk that
carries the SHA-1 and length of the payload so far; a record's last row has those of the whole payload.

Archives are written by tasks into the given shared folder under names of their own; the manifest, which Spark
commits, lists the segments of finished tasks only, so lost executors and repeated attempts leave nothing that is
read. A segment is a run of whole members that one reading task takes.

Of records with equal payloads of at least ``least`` bytes, the one with the smallest page_id is a response and the others
are revisits of it; smaller ones are all responses. Null payloads count as empty. Rows that repeat that page_id and
payload are responses too; a null page_id never is the one referred to. The payload length of a revisit, which holds no payload, is in an
extension header. Line ends in url are dropped from headers. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import session_parallelism, written

#: Bytes of a payload in one row; bytes of an archive in one segment.
CHUNK, SEGMENT = 1 << 18, 1 << 23
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-page").int >> 64 << 64
RECORDS = "page_id long, record_type string, refers_to long, chunk_no int, chunk binary, payload_bytes long, payload_digest string, last boolean"


def record_id(page_id: int | None, digest: bytes = b"") -> str:
    """An id from which the page_id can be read again; of rows without page_id, one from the payload's digest."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest.hex()) if page_id is None else uuid.UUID(int=_SPACE | page_id % (1 << 64))}>"


def page_of(record: str) -> int | None:
    x = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if x >> 64 << 64 != _SPACE:
        return None
    low = x % (1 << 64)
    return low - (1 << 64) if low >> 63 else low


def chunks(pages: DataFrame, least: int = 0, size: int = CHUNK) -> DataFrame:
    """The chunked record table of pages (page_id, url, html), with the response that each record revisits."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("bytes", F.length("payload").cast("long"))
    # of each digest the records of each page, so that no payload goes where its digest goes
    pages_of = rows.where(F.col("bytes") >= least).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    first = pages_of.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("pages")).where("pages > 1 AND first IS NOT NULL").select("digest", "first")
    revisits = pages_of.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("digest").alias("of"), F.col("page_id").alias("page"), F.col("first").alias("refers_to"))
    marked = rows.join(revisits, (F.col("digest") == F.col("of")) & F.col("page_id").eqNullSafe(F.col("page")), "left").drop("of", "page")
    marked = marked.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")))
    parts = F.greatest(F.lit(1), F.ceil(F.length("payload") / size)).cast("int")
    dealt = marked.select("page_id", "url", "digest", "bytes", "refers_to", "payload", parts.alias("chunks"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("chunk_no"))
    return dealt.select("page_id", "url", "digest", "bytes", "refers_to", "chunks", "chunk_no", F.substring("payload", F.col("chunk_no") * size + 1, F.lit(size)).alias("chunk"))


def _digest(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def _head(row: dict, date: str) -> bytes:
    """The WARC header, and of a response also the HTTP header that begins its block."""
    revisit = row["refers_to"] is not None
    http = b"" if revisit else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    fields = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(row['page_id'], row['digest'])}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {''.join((row['url'] or '').splitlines())}", f"WARC-Payload-Digest: sha1:{_digest(row['digest'])}", f"X-Payload-Length: {row['bytes']}", f"Content-Length: {len(http) + (0 if revisit else row['bytes'])}",
    ]
    fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(row['refers_to'])}"] if revisit else ["Content-Type: application/http;msgtype=response"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + http


def write(chunked: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write archives into folder; the manifest has a row (path, start, length) per segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        path = f"{root}/part-{task.partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        out, segments, begun = None, [], 0
        try:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                    if out is None:
                        out = store.open_output_stream(path, compression=None)
                    if row["chunk_no"] == 0:
                        if out.tell() - begun >= SEGMENT:
                            segments.append((path, begun, out.tell() - begun))
                            begun = out.tell()
                        member = zlib.compressobj(level, zlib.DEFLATED, 31)
                        out.write(member.compress(_head(row, date)))
                    out.write(member.compress(row["chunk"]))
                    if row["chunk_no"] == row["chunks"] - 1:
                        out.write(member.compress(b"\r\n\r\n") + member.flush())
        finally:
            if out is not None:
                end = out.tell()
                out.close()
        if out is not None:
            segments.append((path, begun, end - begun))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*segments, strict=True)) or [()] * 3, [pa.string(), pa.int64(), pa.int64()], strict=True)], ["path", "start", "length"])

    return written(chunked.mapInArrow(run, "path string, start long, length long"), "warc-manifest")


def _inflated(file: pa.NativeFile, left: int) -> Iterator[tuple[bytes, bool]]:
    """Pieces of the members in the next left bytes of file; True comes with the last piece of a member."""
    member, raw, within = zlib.decompressobj(31), b"", False
    while left or raw or within:
        if not raw and left:
            raw = file.read(min(left, CHUNK))
            if not raw:
                raise EOFError("archive ends inside a segment")
            left -= len(raw)
        ended = not raw
        piece = member.decompress(raw, CHUNK)
        if within := not member.eof:
            raw = member.unconsumed_tail
            if ended and not piece:
                raise EOFError("archive ends inside a member")
            yield piece, False
        else:
            raw = member.unused_data
            yield piece, True
            member = zlib.decompressobj(31)


def _records(file: pa.NativeFile, length: int) -> Iterator[tuple]:
    """Rows of RECORDS; a record's payload is never held as a whole."""
    buffer, head, block = b"", None, 0
    for piece, end in _inflated(file, length):
        buffer += piece
        if head is None:
            cut = buffer.find(b"\r\n\r\n")
            if cut < 0:
                continue
            head = dict(line.split(": ", 1) for line in buffer[:cut].decode().split("\r\n")[1:])
            buffer, block = buffer[cut + 4 :], int(head["Content-Length"])
            http, total, number, sha = block > 0, 0, 0, hashlib.sha1()
            page, revisits = page_of(head["WARC-Record-ID"]), head.get("WARC-Refers-To")
        if http:
            cut = buffer.find(b"\r\n\r\n")
            if cut < 0:
                continue
            block -= cut + 4
            buffer, http = buffer[cut + 4 :], False
        own, buffer = buffer[:block], buffer[block:]
        block -= len(own)
        total += len(own)
        sha.update(own)
        if not end:
            if own:
                yield page, head["WARC-Type"], page_of(revisits) if revisits else None, number, own, total, _digest(sha.digest()), False
                number += 1
            continue
        if block or buffer != b"\r\n\r\n":
            raise ValueError(f"record {head['WARC-Record-ID']} has a wrong length")
        told = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if revisits:
            yield page, head["WARC-Type"], page_of(revisits), 0, b"", int(head["X-Payload-Length"]), told, True
        elif told != _digest(sha.digest()):
            raise ValueError(f"record {head['WARC-Record-ID']} has a wrong digest")
        else:
            yield page, head["WARC-Type"], None, number, own, total, told, True
        buffer, head = b"", None


def read(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The chunked record table of the archives in folder that the manifest lists: RECORDS, a row per chunk. Without payloads, chunks are
    null and only each record's last row is returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start, length in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "length")), strict=True):
                rows: list[tuple] = []
                size = 0
                with store.open_input_file(path) as file:
                    file.seek(start)
                    for row in _records(file, length):
                        if payloads or row[-1]:
                            rows.append(row if payloads else (*row[:4], None, *row[5:]))
                            size += len(row[4]) if payloads else 64
                        if size >= SEGMENT:
                            yield _batch(rows)
                            rows, size = [], 0
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 8, kinds, strict=True)], ["page_id", "record_type", "refers_to", "chunk_no", "chunk", "payload_bytes", "payload_digest", "last"])

    # the manifest is small; a segment is work for one task, and of very many segments a task takes several
    n = max(1, min(manifest.count(), 64 * session_parallelism(manifest.sparkSession)))
    return manifest.repartition(n, "path", "start").mapInArrow(run, RECORDS)
