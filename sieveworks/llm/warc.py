"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends in a seek table (a skippable frame with the
sizes of all frames), and an index maps each record identifier to bundle, frame and offset within the frame, so one
record costs one frame to read. Of records with equal payloads of at least ``MIN_SHARED`` bytes the one with the
smallest page_id is the response, the others revisit it.

Defined results: null html is an empty payload; a null url is written as the record's own identifier; rows that
repeat a page_id with one payload all get the same record type; a null page_id is never the one revisited unless all
are null, and then all are responses. An empty table gives an archive without bundles. Other columns are not archived.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import SALTS, fresh_path, table, text_of, written

MIN_SHARED = 100
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
CAPTURED = "2000-01-01T00:00:00Z"

INDEX = "page_id bigint, bundle string, frame int, offset int, length int"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, bundle string, frame int, offset int"


def record(page_id, url, payload: bytes, digest: str, size: int, revisits) -> bytes:
    """One WARC record with an HTTP block; a revisit keeps the headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisits is not None else http + payload
    name = f"urn:page:{'' if page_id is None else page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if revisits is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {CAPTURED}",
        f"WARC-Target-URI: {name if url is None else quote(url, safe='%/:?#[]@!$&()*+,;=~-._')}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if revisits is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{revisits}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, bytes, int]:
    """Header fields, HTTP head and body of the record at ``at``, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    fields = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
    begin = end + 4
    stop = begin + int(fields["Content-Length"])
    split = data.index(b"\r\n\r\n", begin) + 4
    return fields, data[begin:split], data[split:stop], stop + 4


class BundleWriter:
    """Writes frames to one file, then their seek table; the file gets its name when it is whole."""

    def __init__(self, root: str):
        self.store, folder = pa.fs.FileSystem.from_uri(f"{root}/bundles")
        self.store.create_dir(folder, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.path = f"{folder}/{self.name}"
        self.out = self.store.open_output_stream(f"{self.path}.part")
        self.sizes: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.held_bytes = 0
        self.written = 0
        self.packer = zstandard.ZstdCompressor(level=6)

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset of the record within it."""
        if self.held and self.held_bytes + len(data) > FRAME_BYTES:
            self.flush()
        at = len(self.sizes), self.held_bytes
        self.held.append(data)
        self.held_bytes += len(data)
        return at

    def flush(self) -> None:
        if self.held:
            packed = self.packer.compress(b"".join(self.held))
            self.out.write(packed)
            self.sizes.append((len(packed), self.held_bytes))
            self.written += len(packed)
            self.held, self.held_bytes = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()
        self.store.move(f"{self.path}.part", self.path)


def write_batches(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write a partition's records and yield their index. Names are new for each attempt of a task: only bundles in the
    index of the attempt that counted are read."""
    bundle = None
    for batch in batches:
        index = []
        for page_id, url, payload, digest, size, revisits in zip(*(batch.column(c) for c in range(6)), strict=True):
            bundle = bundle or BundleWriter(root)
            data = record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), size.as_py(), revisits.as_py())
            frame, offset = bundle.add(data)
            index.append((page_id.as_py(), bundle.name, frame, offset, len(data)))
            if bundle.written > BUNDLE_BYTES:
                bundle.close()
                bundle = None
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*index, strict=True) if index else [[]] * 5, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)],
            names=["page_id", "bundle", "frame", "offset", "length"],
        )
    if bundle:
        bundle.close()


def typed_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, size, refers_to: the payload is shuffled once, by (digest, salt)."""
    payload = F.encode(text_of("html"), "UTF-8")
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    hashed = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("bigint").alias("size"), salt.alias("salt"))
    part = hashed.filter(F.col("size") >= MIN_SHARED).groupBy("digest", "salt").agg(F.min("page_id").alias("low"), F.count(F.lit(1)).alias("n"))
    first = part.groupBy("digest").agg(F.min("low").alias("first"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    back = part.select("digest", "salt").join(first, "digest")
    return hashed.join(back, ["digest", "salt"], "left").select(
        "page_id", "url", F.when(F.col("page_id").eqNullSafe(F.col("first")) | F.col("first").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"),
        "digest", "size", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"),
    )


def write_archive(pages: DataFrame, root: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``root``; returns the index, which is also kept there."""
    index = typed_records(pages).mapInArrow(lambda it: write_batches(root, it), INDEX)
    index.write.parquet(f"{root}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{root}/index")


def seek_table(store, path: str) -> list[tuple[int, int]]:
    """(start, compressed size) of every frame, from the footer."""
    length = store.get_file_info(path).size
    with store.open_input_file(path) as file:
        file.seek(length - 9)
        frames, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        file.seek(length - 9 - 8 * frames)
        table_bytes = file.read(8 * frames)
    starts, at = [], 0
    for k in range(frames):
        packed, _ = struct.unpack_from("<II", table_bytes, 8 * k)
        starts.append((at, packed))
        at += packed
    return starts


def read_frame(file, start: int, size: int) -> bytes:
    file.seek(start)
    return zstandard.ZstdDecompressor().decompress(file.read(size))


def described(data: bytes, at: int) -> tuple[tuple, bytes | None, int]:
    """Page id, size, digest, type, refers_to and url of a record; its payload (None for a revisit); the next one's place."""
    fields, http, body, following = parse(data, at)
    number = lambda name: int(name[10:-1]) if name and name != "<urn:page:>" else None
    kind = fields["WARC-Type"]
    size = int(next(line for line in http.decode().split("\r\n") if line.startswith("Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"][7:]
    if kind == "response":
        if hashlib.sha256(body).hexdigest() != digest or len(body) != size:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    found = number(fields["WARC-Record-ID"]), size, digest, kind, number(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"]
    return found, body if kind == "response" else None, following


def read_batches(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("url", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()),
    ])
    store, folder = pa.fs.FileSystem.from_uri(f"{root}/bundles")
    for batch in batches:
        for name in batch.column(0).to_pylist():
            starts = seek_table(store, f"{folder}/{name}")
            with store.open_input_file(f"{folder}/{name}") as file:
                for frame, (start, size) in enumerate(starts):
                    data, at, rows = read_frame(file, start, size), 0, []
                    while at < len(data):
                        found, _, following = described(data, at)
                        rows.append((*found, name, frame, at))
                        at = following
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_archive(spark: SparkSession, root: str) -> DataFrame:
    """Read every record of the archive back, with its payload's size and digest checked."""
    bundles = written(spark.read.schema(INDEX).parquet(f"{root}/index").select("bundle").distinct(), "bundles")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return bundles.repartition(parts, "bundle").mapInArrow(lambda it: read_batches(root, it), RECORDS)


def read_records(index: DataFrame, wanted: DataFrame, root: str) -> DataFrame:
    """Payloads of the records named in ``wanted`` (page_id): only their frames are read."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pa.fs.FileSystem.from_uri(f"{root}/bundles")
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                path = f"{folder}/{x['bundle']}"
                with store.open_input_file(path) as file:
                    data = read_frame(file, *seek_table(store, path)[x["frame"]])
                for offset in x["offsets"]:
                    found, body, _ = described(data, offset)
                    rows.append((found[0], found[3], found[4], body))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["page_id", "record_type", "refers_to", "payload"])

    frames = index.join(wanted.select("page_id").distinct(), "page_id").groupBy("bundle", "frame").agg(F.collect_list("offset").alias("offsets"))
    return frames.mapInArrow(fetch, "page_id bigint, record_type string, refers_to bigint, payload binary")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, as read back from the archives."""
    root = fresh_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), root)
    return read_archive(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM h WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM h LEFT JOIN f USING (digest)
"""
