"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with whole records,
and at its end a skippable frame with the seek table (the public seekable
format, with checksums). Any Zstandard reader can read the bundle as a stream;
with the table, one record costs one frame.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 18, 1 << 26, 3
DATE = "1970-01-01T00:00:00Z"
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
BUNDLES = (
    "bundle string, n_records int, n_frames int, data binary, "
    "records array<struct<record_id: string, page_id: bigint, frame: int, offset: bigint, length: bigint>>"
)


def record(record_id: str, page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> bytes:
    """One resource record. A null url or page has no header line; a null html
    is an empty body with ``WARC-Truncated: unspecified``. Line ends in a url
    are written as %0D and %0A, and such a url once more in base 64."""
    body = (html or "").encode()
    lines = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
        if "\r" in url or "\n" in url:
            lines.append("X-Url: " + base64.b64encode(url.encode()).decode())
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if html is None:
        lines.append("WARC-Truncated: unspecified")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[str, int | None, str | None, str | None]:
    """What ``record`` was made of."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])].decode()
    page = fields.get("X-Page-Id")
    return (
        fields["WARC-Record-ID"][10:-1],
        None if page is None else int(page),
        base64.b64decode(fields["X-Url"]).decode() if "X-Url" in fields else fields.get("WARC-Target-URI"),
        None if "WARC-Truncated" in fields else body,
    )


class Bundle:
    """Takes records, closes frames when they are full."""

    def __init__(self, name: str, frame_bytes: int, level: int):
        self.name, self.frame_bytes = name, frame_bytes
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.data, self.table, self.open, self.size = bytearray(), [], bytearray(), 0
        self.records: list[dict] = []

    def add(self, page_id: int | None, url: str | None, html: str | None) -> None:
        digest = xxhash.xxh3_128_hexdigest(f"{url!r}\n{html!r}".encode("utf-8", "surrogatepass"))
        name = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{self.name}/{len(self.records)}/{page_id}/{digest}"))
        raw = record(name, page_id, url, html)
        if self.open and len(self.open) + len(raw) > self.frame_bytes:
            self.flush()
        self.records.append({"record_id": name, "page_id": page_id, "frame": len(self.table), "offset": len(self.open), "length": len(raw)})
        self.open += raw
        self.size += len(raw)

    def flush(self) -> None:
        raw = bytes(self.open)
        frame = self.zip.compress(raw)
        self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.data += frame
        self.open.clear()

    def close(self) -> dict:
        if self.open:
            self.flush()
        body = b"".join(struct.pack("<III", *x) for x in self.table)
        body += struct.pack("<IBI", len(self.table), 0x80, _SEEKABLE)
        self.data += struct.pack("<II", _SKIPPABLE, len(body)) + body
        return {"bundle": self.name, "n_records": len(self.records), "n_frames": len(self.table), "data": bytes(self.data), "records": self.records}


def seek_table(data: bytes) -> list[tuple[int, int, int, int]]:
    """Of each frame: where it starts, its size, its size unpacked, its checksum;
    read from the end of the bundle."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != _SEEKABLE or not flags & 0x80:
        raise ValueError("no seek table")
    at, out = 0, []
    for size, raw, check in struct.iter_unpack("<III", data[len(data) - 9 - 12 * n : len(data) - 9]):
        out.append((at, size, raw, check))
        at += size
    return out


def read(data: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record: only its frame is unpacked."""
    at, size, raw, check = seek_table(data)[frame]
    unpacked = zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=raw)
    if xxhash.xxh64_intdigest(unpacked) & 0xFFFFFFFF != check:
        raise ValueError(f"frame {frame} is damaged")
    return unpacked[offset : offset + length]


def bundles(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL, run_id: str | None = None,
) -> DataFrame:
    """(bundle, n_records, n_frames, data, records): whole bundle files, and where
    each record lies: its frame, and offset and length in the unpacked frame.

    Each task packs the rows it reads, so nothing is shuffled. Names of bundles come
    from ``run_id`` (drawn once for the table, unless given) and the task's number, so
    a task that runs again writes the same and another run's bundles have other
    names; record ids come from the bundle, the place in it, url and content. A
    bundle must fit a binary value of Spark (2 GiB). A record larger than
    a frame has a frame of its own, one larger than a bundle ends its bundle.
    Every row gets a record, whatever is null (see ``record``) and however often
    it repeats; a task without rows makes no bundle. Other columns are left out."""
    rows = pick(pages, id_col, url_col, html_col).toDF("page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("bigint"))
    schema = pa.schema(
        [("bundle", pa.string()), ("n_records", pa.int32()), ("n_frames", pa.int32()), ("data", pa.binary()),
         ("records", pa.list_(pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))]
    )

    prefix = run_id or uuid.uuid4().hex[:16]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        now = Bundle(f"{prefix}-{task:06d}-{n:06d}", frame_bytes, level)
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                now.add(page_id, url, html)
                if now.size >= bundle_bytes:
                    yield pa.RecordBatch.from_pylist([now.close()], schema)
                    n += 1
                    now = Bundle(f"{prefix}-{task:06d}-{n:06d}", frame_bytes, level)
        if now.records:
            yield pa.RecordBatch.from_pylist([now.close()], schema)

    return rows.mapInArrow(run, BUNDLES)


def unpack(packed: DataFrame) -> DataFrame:
    """(bundle, record_id, page_id, url, html): every record, read frame by frame."""
    names = ["bundle", "record_id", "page_id", "url", "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data, records in zip(*(batch.column(c).to_pylist() for c in ("bundle", "data", "records"))):
                frames, rows = {}, []
                table, unzip = seek_table(data), zstandard.ZstdDecompressor()
                for r in records:
                    if r["frame"] not in frames:
                        at, size, raw, _ = table[r["frame"]]
                        frames = {r["frame"]: unzip.decompress(data[at : at + size], max_output_size=raw)}
                    rows.append((name, *parse(frames[r["frame"]][r["offset"] : r["offset"] + r["length"]])))
                kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return packed.select("bundle", "data", "records").mapInArrow(run, "bundle string, record_id string, page_id bigint, url string, html string")


def save(packed: DataFrame, folder: str) -> None:
    """Bundles as files ``<bundle>.warc.zst`` of a folder that all executors share: a
    path, or a URI of a file system that Arrow knows (file, hdfs, s3, gs). Each is
    written under another name and renamed, so a task that is lost or runs twice
    leaves whole files only."""
    uri = folder.rstrip("/")

    def put(rows: Iterator) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
        store.create_dir(base, recursive=True)
        for row in rows:
            part = f"{base}/.{row.bundle}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(row.data)
            store.move(part, f"{base}/{row.bundle}.warc.zst")

    packed.select("bundle", "data").foreachPartition(put)


def op6_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles(table(spark, sf_dir, "pages"))
