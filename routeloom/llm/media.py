"""Media columns: content-addressed payloads in tar shards.

A text's bytes become an 8-bit grey image (rows of ``WIDTH`` samples, stored as
PNG), addressed by the SHA-256 of the stored form.  Tasks append payloads to tar
shards in the shared folder; a payload that a shard already holds is not stored
again.  Rows carry digest, shard, offset and length.  A read of the first
``HEADER_BYTES`` of a payload fills the metadata columns; a range read of the
payload gives the samples back, from which the features are computed.

A shard is written under a name of its own attempt and then renamed to the digest
of its index, so a task that runs twice leaves one whole shard.

Defined results: a null text is empty and stored as one row of padding; equal
texts give equal values, in whatever shards; rows that repeat an id are rows of their own, a
null id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

WIDTH = 576
PAD = 255
HEADER_BYTES = 33
SHARD_BYTES = 32 << 20
SHARD_ROWS = 20_000
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEMA = (
    "doc_id long, n_bytes long, digest string, shard string, offset long, length long, "
    "width int, height int, bit_depth int, payload_bytes long, payload_sha256 string, "
    "tail_crc32 long, media_sha256 string, feature string"
)
TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
FIELDS = [tuple(reversed(x.split())) for x in SCHEMA.split(", ")]


def to_payload(data: bytes, width: int = WIDTH) -> bytes:
    """Pad with 255 to a positive multiple of ``width``."""
    return data + bytes([PAD]) * (max(width, -(-len(data) // width) * width) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode(payload: bytes, width: int = WIDTH) -> bytes:
    """An 8-bit grey PNG without row filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first bytes alone."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a stored payload")
    return struct.unpack(">IIB", first[16:25])


def decode(stored: bytes) -> np.ndarray:
    width, height, _ = header(stored[:HEADER_BYTES])
    at, data = 8, []
    while at < len(stored):
        (n,), kind = struct.unpack(">I", stored[at : at + 4]), stored[at + 4 : at + 8]
        if kind == b"IDAT":
            data.append(stored[at + 8 : at + 8 + n])
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Size, mean, deviation and a histogram of 16 bins, as text."""
    counts = np.bincount(samples.reshape(-1), minlength=256)
    total, values = int(counts.sum()), np.arange(256)
    first, second = int((counts * values).sum()), int((counts * values * values).sum())
    mean = first / total
    spread = max(0.0, second / total - mean * mean) ** 0.5
    bins = ",".join(map(str, counts.reshape(16, 16).sum(axis=1).tolist()))
    return f"{samples.shape[1]}x{samples.shape[0]};mean={mean:.6f};sd={spread:.6f};hist={bins}"


class Shard:
    """One tar file in the making; also the documents that point into it."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.size = 0
        self.places: dict[str, tuple[int, int]] = {}
        self.docs: list[tuple] = []

    def add(self, doc, n_bytes: int, stored: bytes) -> None:
        digest = hashlib.sha256(stored).hexdigest()
        if digest not in self.places:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(stored)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.places[digest] = (self.size + len(head), len(stored))
            block = head + stored + b"\0" * (-len(stored) % 512)
            self.parts.append(block)
            self.size += len(block)
        self.docs.append((doc, n_bytes, digest))

    def write(self, fs, folder: str) -> str:
        name = hashlib.sha256("".join(self.places).encode()).hexdigest()[:32] + ".tar"
        attempt = f"{folder}/.{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(attempt) as out:
            for part in self.parts:
                out.write(part)
            out.write(b"\0" * 1024)
        fs.move(attempt, f"{folder}/{name}")
        self.parts = []
        return name


def read_rows(fs, folder: str, name: str, shard: Shard) -> Iterator[tuple]:
    """The rows of a shard's documents, from the stored bytes."""
    known: dict[str, tuple] = {}
    with fs.open_input_file(f"{folder}/{name}") as source:
        for digest, (offset, length) in shard.places.items():
            meta = header(source.read_at(HEADER_BYTES, offset))
            stored = source.read_at(length, offset)
            samples = decode(stored)
            payload = samples.tobytes()
            known[digest] = (
                digest, f"{folder}/{name}", offset, length, *meta, len(payload), hashlib.sha256(payload).hexdigest(),
                zlib.crc32(payload[-32:]), hashlib.sha256(stored).hexdigest(), feature(samples),
            )
    for doc, n_bytes, digest in shard.docs:
        yield (doc, n_bytes, *known[digest])


def store_media(docs: DataFrame, store: str, width: int = WIDTH, shard_bytes: int = SHARD_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Store each text below the folder ``store`` (a URI that pyarrow's file systems open); a shard ends at so many bytes or rows that point into it."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pfs

        fs, folder = pfs.FileSystem.from_uri(store)
        fs.create_dir(folder, recursive=True)

        def done(shard: Shard) -> pa.RecordBatch:
            rows = list(read_rows(fs, folder, shard.write(fs, folder), shard))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, TYPES[kind]) for c, (kind, _) in zip(zip(*rows, strict=True), FIELDS, strict=True)], [n for _, n in FIELDS]
            )

        shard = Shard()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                shard.add(doc, len(data), encode(to_payload(data, width), width))
                if shard.size >= shard_bytes or len(shard.docs) >= shard_rows:
                    yield done(shard)
                    shard = Shard()
        if shard.docs:
            yield done(shard)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
