"""Media columns: payloads as images in tar shards, addressed by content, with metadata from header-only range reads."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .scratch import Scratch

#: Samples of a row of the image, bytes of a shard and of a slice that one task reads, compression, and digests that one task remembers.
WIDTH, SHARD_BYTES, SLICE_BYTES, LEVEL, REMEMBERED = 64, 256 << 20, 16 << 20, 6, 200_000
#: Fixed values of the image format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEAD = len(SIGNATURE) + 25


def padded(text: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of WIDTH."""
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """A lossless grey image of WIDTH samples of 8 bits a row."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, of the first HEAD bytes of an image."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR" or zlib.crc32(data[12:29]) != struct.unpack(">I", data[29:33])[0]:
        raise ValueError("not the header of an image")
    return struct.unpack(">IIB", data[16:25])


def decode(data: bytes) -> bytes:
    """The samples, as they were stored."""
    width, height, _ = header(data)
    at, packed = 8, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples, and how many lie in each eighth of their range."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    mean = int(counts @ np.arange(256)) / len(x)
    deviation = max(0.0, int(counts @ np.arange(256) ** 2) / len(x) - mean * mean) ** 0.5
    return f"mean={mean:.4f};sd={deviation:.4f};eighths={','.join(map(str, counts.reshape(8, 32).sum(1)))}"


INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def _store(batches, folder: str):
    out, known = None, {}
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = (text.as_py() or "").encode()
            payload = padded(text)
            digest = hashlib.sha256(payload).hexdigest()
            if digest not in known:
                if out is not None and out.tell() >= SHARD_BYTES:
                    out.write(bytes(1024))
                    out.close()
                    out = None
                if out is None:
                    shard, out = files.create(folder, "shard", ".tar")
                if len(known) >= REMEMBERED:
                    known.clear()
                data = encode(payload)
                info = tarfile.TarInfo(f"{digest}.png")
                info.size = len(data)
                out.write(info.tobuf(tarfile.USTAR_FORMAT))
                known[digest] = shard, out.tell(), len(data)
                out.write(data + bytes(-len(data) % 512))
            rows.append((doc, len(text), digest, *known[digest]))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
    if out is not None:
        out.write(bytes(1024))
        out.close()


METADATA = "digest string, width long, height long, bits long"
CONTENT = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read(batches, content: bool):
    """Each row's metadata from the first bytes of its image; with content, also what the whole stored image holds."""
    shard, source = None, None
    for batch in batches:
        rows = []
        for digest, path, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if path != shard:
                if source is not None:
                    source.close()
                shard, source = path, files.random_access(path)
            row = (digest, *header(source.read_at(HEAD, offset)))
            if content:
                data = source.read_at(length, offset)
                payload = decode(data)
                own = hashlib.sha256(payload).hexdigest()
                if own != digest:
                    raise ValueError(f"content {own} under the address {digest}")
                row += len(payload), own, zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)
            rows.append(row)
        if rows:
            fields = (METADATA + ", " + CONTENT if content else METADATA).split(", ")
            kinds = [pa.string() if x.endswith("string") else pa.int64() for x in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in fields])
    if source is not None:
        source.close()


def store(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(index, addresses). index: doc_id, n_bytes, digest, one row per document. addresses: digest, shard, offset, length, one row per content.

    Each text, as UTF-8 and padded, is an image in a tar shard. A task stores a content once; contents that several tasks stored have one address, the
    smallest, so equal texts have equal rows, and the other copies stay unread in their shards. The addresses are grouped by digest after a partial
    aggregation; no text is shuffled.
    Text null: empty, 64 bytes 0. doc_id may be null or repeat. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    index = scratch.keep(rows.mapInArrow(partial(_store, folder=scratch.path("shards")), INDEX), "stored")
    address = scratch.keep(index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*"), "addresses")
    return index.select("doc_id", "n_bytes", "digest"), address


def described(index: DataFrame, facts: DataFrame) -> DataFrame:
    """Each row of an index with the facts of its content. The one join by digest: a content that very many rows share, as the empty one, can be split."""
    return index.join(facts.hint("merge"), "digest")


def _dealt(addresses: DataFrame) -> DataFrame:
    # a slice of a shard is a task's work: dealt by number, since the rows themselves are small
    slices = addresses.select("digest", "shard", "offset", "length").withColumn("slice", F.floor(F.col("offset") / SLICE_BYTES))
    many = 2 * max(1, slices.select("shard", "slice").distinct().count())
    return slices.repartition(many, "shard", "slice").drop("slice").sortWithinPartitions("shard", "offset")


def metadata(addresses: DataFrame) -> DataFrame:
    """digest, width, height, bits: from range reads of the images' first bytes alone."""
    return _dealt(addresses).mapInArrow(partial(_read, content=False), METADATA)


def contents(addresses: DataFrame) -> DataFrame:
    """metadata() and what the stored bytes hold: payload and media sizes and digests, and features; each content is read once."""
    return _dealt(addresses).mapInArrow(partial(_read, content=True), f"{METADATA}, {CONTENT}")
