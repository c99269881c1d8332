"""Seekable Zstandard WARC bundles.

Writing: pages whose payloads are equal are found by one narrow aggregation over payload digests (partial sums first, so
a payload of a third of all pages costs one row per task); the page with the largest page_id keeps the payload, the
others become revisit records. Digests that repeat are broadcast behind a check of their number, so payloads stay where
they were read; beyond it the adaptive skew join splits a digest of many pages. Every task writes bundles of its own:
records are gathered into frames of about FRAME_BYTES, each an independent Zstandard frame; a skippable frame with the
seek table closes the bundle. The index maps each record to bundle, frame and offset inside the frame. A bundle is written
under a temporary name and renamed, and only index rows of tasks that succeeded count, so a lost executor leaves nothing
half-written in the index.

Reading: index rows meet by bundle and stretch of FRAMES frames, in as many tasks as the records' bytes ask for
(READ_BYTES each), so neither one bundle nor a narrow index makes a single task; a task opens the bundle, reads the seek
table from its end, seeks to each frame that it needs and cuts the records out of it. Memory is bounded by one frame (or
one record, if that is larger).

Bundles lie in the shared folder of the session (spark.checkpoint.dir), which pyarrow.fs must be able to open.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import few, map_rows, table_path, written

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 30
FRAMES, READ_BYTES = 8, 16 << 20
# Fixed values of the seekable format: skippable-frame magic, footer magic.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "page_id long, bundle string, frame int, offset long, length long"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame for frames of these compressed and decompressed sizes."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of every frame of a bundle."""
    total = file.size()
    file.seek(total - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != _SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if flags & 0x80 else 8
    file.seek(total - 9 - count * width)
    found, at = [], 0
    entries = file.read(count * width)
    for k in range(count):
        packed, plain = struct.unpack_from("<II", entries, k * width)
        found.append((at, packed, plain))
        at += packed
    return found


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'-' if page_id is None else page_id}:{digest}>"


def _page_of(urn: str) -> int | None:
    number = urn.split(":")[2]
    return None if number == "-" else int(number)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=~"))
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to, digest)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers of a record, its HTTP headers and its payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["http"] = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    fields["payload"] = None if fields["WARC-Type"] == "revisit" else payload
    return fields


class _Bundle:
    def __init__(self, folder: str, frame_bytes: int):
        self.system, base = fs.FileSystem.from_uri(folder)
        self.system.create_dir(base, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.part, self.path = f"{base}/.{self.name}.part", f"{base}/{self.name}"
        self.file = self.system.open_output_stream(self.part)
        self.pack, self.limit = zstandard.ZstdCompressor(level=3), frame_bytes
        self.buffer, self.filled, self.sizes, self.total, self.index = [], 0, [], 0, []

    def add(self, page_id: int | None, raw: bytes) -> None:
        self.index.append((page_id, self.name, len(self.sizes), self.filled, len(raw)))
        self.buffer.append(raw)
        self.filled += len(raw)
        if self.filled >= self.limit:
            self.flush()

    def flush(self) -> None:
        if self.buffer:
            frame = self.pack.compress(b"".join(self.buffer))
            self.file.write(frame)
            self.sizes.append((len(frame), self.filled))
            self.total += len(frame)
            self.buffer, self.filled = [], 0

    def close(self) -> list[tuple]:
        self.flush()
        self.file.write(seek_table(self.sizes))
        self.file.close()
        self.system.move(self.part, self.path)
        return self.index


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes a WARC record per row of pages (page_id, url, html) and returns the index as a table.

    A null html is an empty payload, a null url leaves out the target header, a null page_id is kept and never the
    target of a revisit while a copy has one. Of rows with equal payloads of at least min_bytes bytes, those with the
    largest page_id are responses, the rest revisits of it. Other columns are ignored; an empty table gives an empty
    index.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.withColumn("digest", F.sha1("payload"))
    copies = keyed.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "keeper")
    planned = keyed.join(few(written(copies, "copies")), "digest", "left").select("page_id", "url", "payload", "keeper")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        bundle = None
        for page_id, url, payload, keeper in rows:
            bundle = bundle or _Bundle(folder, frame_bytes)
            revisit = keeper is not None and keeper != page_id
            bundle.add(page_id, record(page_id, url, bytes(payload), keeper, revisit, date))
            if bundle.total >= bundle_bytes:
                yield from bundle.close()
                bundle = None
        if bundle:
            yield from bundle.close()

    return written(map_rows(planned, run, _INDEX, chunk=64), "warc-index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Reads the records of an index back: page_id, payload_bytes, payload_digest, record_type, refers_to, payload_ok.

    The digest and size of a response are computed from the payload that was read, and payload_ok tells whether its
    header agrees; those of a revisit are in its headers.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        system, base = fs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor()
        name, file, table, at, frame = None, None, [], None, b""
        for bundle, k, offset, length in rows:
            if bundle != name:
                if file:
                    file.close()
                name, file, at = bundle, system.open_input_file(f"{base}/{bundle}"), None
                table = read_seek_table(file)
            if k != at:
                start, packed, plain = table[k]
                file.seek(start)
                frame, at = unpack.decompress(file.read(packed), max_output_size=plain), k
            found = parse(frame[offset : offset + length])
            digest, size = found["WARC-Payload-Digest"].removeprefix("sha1:"), int(found["http"]["Content-Length"])
            payload, kind, ok = found["payload"], found["WARC-Type"], True
            if payload is not None:
                stated, digest, size = (digest, size), base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                ok = stated == (digest, size)
            yield _page_of(found["WARC-Record-ID"]), size, digest, kind, _page_of(found["WARC-Refers-To"]) if kind == "revisit" else None, ok
        if file:
            file.close()

    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // READ_BYTES))
    stretch = F.floor(F.col("frame") / FRAMES)
    placed = index.select("bundle", "frame", "offset", "length").repartition(tasks, "bundle", stretch).sortWithinPartitions("bundle", "frame", "offset")
    return map_rows(placed, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload_ok boolean")


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes archives into the shared folder and reads every record back."""
    folder = table_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, min_bytes), folder)
