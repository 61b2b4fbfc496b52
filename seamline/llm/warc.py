"""Gzipped WARC archives: a writer with revisit records and a splittable reader.

Each record is a gzip member of its own. The reader's tasks get byte ranges;
a task scans its range for the gzip magic, takes a candidate for a record only
if it inflates to a WARC version line and a full header and its gzip checksum
holds, and owns the records that start inside its range (the last one is read
past the range's end). Ranges therefore need no index. A payload that itself
holds an uncompressible gzipped WARC could show such a member inside; the
reader follows the chain of member ends, so only a range that starts inside
that payload could meet it.

Files are written under attempt-unique names, and only those that a finished
task reported are read: a lost or repeated task leaves an unread file at most.
Nulls: a null payload is empty, a null url is an empty target, a row without
an id is a response that nothing refers to. Repeated rows make a record each;
an empty table makes no archive and no rows. A payload of any length is one
record, and is held whole by the task that writes or reads it. Equal payloads
under one page_id are told apart by nothing: neither refers to the other.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm.shared import fresh_path, written

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK = 1 << 20
HOT_SHARE = 1000


def _id(page_id: int | None) -> str:
    raw = uuid.uuid4().bytes[:8] if page_id is None else (page_id & (1 << 64) - 1).to_bytes(8)
    return f"<urn:uuid:{uuid.UUID(bytes=(b'nullpage' if page_id is None else b'pagerow_') + raw)}>"


def _page_of(record_id: str) -> int | None:
    raw = uuid.UUID(record_id.strip("<>")).bytes
    return int.from_bytes(raw[8:], signed=True) if raw.startswith(b"pagerow_") else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 1) -> bytes:
    """One gzip member with a response, or with a revisit of ``refers_to`` (no payload)."""
    target = re.sub(r"[\r\n]", " ", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(level, wbits=31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def _headers(text: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = text.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}


def _parse(offset: int, data: bytes) -> Record | None:
    at = data.find(b"\r\n\r\n") if data.startswith(b"WARC/1.") else -1  # a url may make the header long
    if at < 0:
        return None
    version, head = _headers(data[:at])
    n = head.get("content-length", "")
    if not version.startswith("WARC/1.") or "warc-type" not in head or not n.isdigit() or data[at + 4 + int(n) :] != b"\r\n\r\n":
        return None
    block = data[at + 4 : at + 4 + int(n)]
    line, _, payload = block.partition(b"\r\n\r\n")
    return Record(offset, head, _headers(line)[1], payload)


class _Source:
    """Bytes of a file from any place, read block by block."""

    def __init__(self, f, size: int):
        self.f, self.size, self.base, self.data = f, size, 0, b""

    def at(self, pos: int, least: int = 1) -> bytes:
        """Bytes from ``pos``, ``least`` of them or all that the file still has."""
        if not self.base <= pos <= self.base + len(self.data) - least:
            self.f.seek(pos)
            self.base, self.data = pos, self.f.read(min(BLOCK, self.size - pos)) if pos < self.size else b""
        return self.data[pos - self.base :] if pos > self.base else self.data


def _member(src: _Source, pos: int) -> tuple[bytes, int] | None:
    """The member at ``pos`` inflated, and where it ends; None if there is no sound one that starts a WARC record."""
    z, out, checked = zlib.decompressobj(31), [], False
    here = pos
    try:
        while not z.eof:
            piece = src.at(here)
            if not piece:
                return None
            if not checked:  # a little first: a false candidate costs little
                out.append(z.decompress(piece, 64))
                if out[0] and not b"WARC/1.".startswith(out[0][:7]):
                    return None
                checked = True
                rest = z.unconsumed_tail
                out.append(z.decompress(rest))
            else:
                out.append(z.decompress(piece))
            here += len(piece) - len(z.unused_data)
    except zlib.error:
        return None
    return b"".join(out), here


def read_range(f, size: int, start: int, end: int) -> Iterator[Record]:
    """The records of an open file that start in ``[start, end)``."""
    src, pos = _Source(f, size), start
    while pos < min(end, size):
        piece = src.at(pos, len(MAGIC))  # a whole magic: it may lie across two blocks
        hit = piece.find(MAGIC)
        if hit < 0:
            pos += max(1, len(piece) - len(MAGIC) + 1)
            continue
        pos += hit
        if pos >= end:
            return
        got = _member(src, pos)
        rec = _parse(pos, got[0]) if got else None
        if rec:
            yield rec
            pos = got[1]
        else:
            pos += 1


def with_refers_to(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Columns page_id, url, html, refers_to: of equal payloads the largest page_id stands, the others refer to it."""
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("_sha", F.sha1(F.encode("html", "utf-8")))
    keys = base.where(F.octet_length("html") >= min_bytes).select("page_id", "_sha")
    # partial aggregation first: a payload that a third of the rows share is one row per task
    best = written(keys.groupBy("_sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"), "payloads")
    # payloads with more than a thousandth of all rows are a thousand at most, and go to all tasks
    many = max(HOT_SHARE, pages.count() // HOT_SHARE)
    hot, cold = best.where(F.col("n") > many).drop("n"), best.where(F.col("n") <= many).drop("n")
    near = keys.join(F.broadcast(hot), "_sha")
    far = keys.join(F.broadcast(hot.select("_sha")), "_sha", "left_anti").join(cold, "_sha")
    later = near.unionByName(far).where("page_id < refers_to").distinct()
    return base.join(later, ["page_id", "_sha"], "left").drop("_sha")


def write_archives(rows: DataFrame, level: int = 1) -> DataFrame:
    """Writes rows (page_id, url, html, refers_to), a file a task; returns the manifest (path, bytes, records)."""
    spark = rows.sparkSession
    folder = fresh_path(spark, "warc")
    fs, where = pafs.FileSystem.from_uri(folder)
    fs.create_dir(where, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = pafs.FileSystem.from_uri(folder)
        path, out, size, count = f"{where}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, refers = (batch.column(k)[i] for k in range(4))
                data = record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes(), refers.as_py(), level)
                out = out or fs.open_output_stream(path, compression=None)
                out.write(data)
                size, count = size + len(data), count + 1
        if out:
            out.close()
            yield pa.record_batch([[path], [size], [count]], names=["path", "bytes", "records"])

    manifest = rows.select("page_id", "url", "html", "refers_to").mapInArrow(write, "path string, bytes long, records long")
    return written(manifest.withColumn("folder", F.lit(folder)), "manifest")


def read_archives(manifest: DataFrame, split_bytes: int = 4 << 20) -> DataFrame:
    """Reads archives (columns folder, path, bytes) by byte ranges; a row for each record.

    A response's payload must have the digest that its header names, else the
    task fails: a damaged archive is never passed over in silence.
    """
    starts = manifest.select("folder", "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    parts = max(8, manifest.sparkSession.sparkContext.defaultParallelism * 4)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, _ = pafs.FileSystem.from_uri(row["folder"])
                out: list[tuple] = []
                with fs.open_input_file(row["path"]) as f:
                    for rec in read_range(f, row["bytes"], row["start"], row["start"] + split_bytes):
                        kind, named = rec.headers["warc-type"], rec.headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and digest(rec.payload) != named:
                            raise ValueError(f"{row['path']} at {rec.offset}: the payload hasn't the digest {named}")
                        refers = rec.headers.get("warc-refers-to")
                        out.append((_page_of(rec.headers["warc-record-id"]), int(rec.http["content-length"]), named, kind, _page_of(refers) if refers else None, row["path"], rec.offset))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "record_offset"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], names=names)

    return starts.repartition(parts, "path", "start").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_offset long")


def archive_round_trip(spark: SparkSession, pages: DataFrame, split_bytes: int = 4 << 20) -> DataFrame:
    """Writes every page to archives and reads them back; fails unless as many records are read as were written."""
    manifest = write_archives(with_refers_to(pages))
    return checked(written(read_archives(manifest, split_bytes), "records"), manifest)


def checked(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """``records``, if they are as many as the manifest (path, records) says."""
    want, got = manifest.agg(F.sum("records")).first()[0] or 0, records.count()
    if got != want:
        raise ValueError(f"{got} records were read of {want} that were written")
    return records
