"""Outputs: sharded Parquet, result tables as CSV or JSON, reports, manifests, redaction."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from functools import partial
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a private path looks like, and what replaces it.
PRIVATE, PLACEHOLDER = r"(?:[A-Za-z]:\\Users\\|/home/|/Users/|/root/)[^\s\"'<>|]*", "<PRIVATE_PATH>"


def write_shards(df: DataFrame, path: str, shards: int = 30) -> None:
    df.repartition(shards).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, whole: bool = True) -> None:
    """A result table: one file with a header, for small tables; or where whole is false, a file with a header from each task, for tables of any size."""
    (df.coalesce(1) if whole else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str, rows: int = 100) -> str:
    """The first rows of a small table as text, also written to a file of the driver's."""
    head = df.limit(rows).collect()
    lines = ["\t".join(df.columns), *("\t".join("" if v is None else str(v) for v in r) for r in head)]
    Path(path).write_text("\n".join(lines) + "\n")
    return "\n".join(lines)


#: Bytes of a file that a task holds at a time.
STEP = 8 << 20


def _hashed(batches):
    for batch in batches:
        sums = []
        for path in batch.column(0).to_pylist():
            store, own = fs.FileSystem.from_uri(path)
            total = hashlib.sha256()
            with store.open_input_stream(own, compression=None) as source:
                while part := source.read(STEP):
                    total.update(part)
            sums.append(total.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], ["path", "bytes", "sha256"])


def manifest(spark: SparkSession, folder: str, tasks: int = 64) -> DataFrame:
    """path, bytes and SHA-256 of each file below a folder.

    Spark lists the files, without reading them; tasks then read each as a stream, so that a file may have any size. The store must be one that pyarrow knows.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes"))
    return found.repartition(tasks).mapInArrow(_hashed, "path string, bytes long, sha256 string")


#: What outputs must not hold: kind, a pattern over bytes that white space and control characters always end, and how many bytes of it are looked at.
SENSITIVE = [
    ("email", rb"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])"),
    ("private_path", rb"(?:[A-Za-z]:\\Users\\|/home/|/Users/|/root/)[^\x00-\x20\"'<>|]{0,1024}"),
    ("access_key", rb"AKIA[A-Z0-9]{16,64}"),
    ("labelled_secret", rb"(?i:password|passwd|secret|token|api_?key)[\"']?[:=][\"']?[A-Za-z0-9+/_.=-]{6,256}"),
]
#: Bytes that no hit exceeds.
LONGEST = 4096
_END = re.compile(rb"[\x00-\x20]")


def _cut(buffer: bytes, done: bool) -> int:
    """How far a buffer can be searched before more of the file is known: up to its last byte that ends every hit, which is sought among the last LONGEST;
    where there is none, hits may begin up to there."""
    if done:
        return len(buffer)
    tail = max(0, len(buffer) - LONGEST)
    ends = [m.end() for m in _END.finditer(buffer, tail)]
    return ends[-1] if ends else tail


def hits_of(source, patterns: list[tuple[str, bytes]], step: int) -> list[tuple[str, int, int]]:
    """(kind, offset, bytes) of all hits in a stream, leftmost and not overlapping for each kind, whatever the steps it is read in."""
    found, buffer, base, done = [], b"", 0, False
    compiled = [(kind, re.compile(p)) for kind, p in patterns]
    start = dict.fromkeys((kind for kind, _ in patterns), 0)  # where each kind's search goes on, in the file
    while not done:
        part = source.read(step)
        done, buffer = not part, buffer + part
        cut = _cut(buffer, done)
        for kind, p in compiled:
            at = start[kind] - base
            while (m := p.search(buffer, at)) and (m.start() < cut):
                found.append((kind, base + m.start(), m.end() - m.start()))
                at = m.end()
            start[kind] = base + max(at, cut)
        keep = min(cut, *(x - base for x in start.values()))
        buffer, base = buffer[keep:], base + keep
    return sorted(found, key=lambda x: (x[1], x[0]))


def _sensitive(batches, patterns, step):
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, own = fs.FileSystem.from_uri(path)
            with store.open_input_stream(own, compression=None) as source:
                rows = hits_of(source, patterns, step)
            for a in range(0, len(rows), 10_000):
                kind, at, n = zip(*rows[a : a + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(kind)), pa.array(kind), pa.array(at, pa.int64()), pa.array(n, pa.int64())], ["path", "kind", "offset", "bytes"])


def sensitive(spark: SparkSession, folder: str, patterns: list[tuple[str, bytes]] = SENSITIVE, tasks: int = 64, step: int = STEP) -> DataFrame:
    """path, kind, offset, bytes of what the files below a folder must not hold. Files are read as streams, each by one task, in steps; hits across the ends of
    steps are found once. Offsets count bytes of the file as it is stored, so compressed files are searched as such. Values themselves are not returned."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return found.repartition(tasks).mapInArrow(partial(_sensitive, patterns=patterns, step=step), "path string, kind string, offset long, bytes long")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that all tasks can write to: in spark.checkpoint.dir, or where that is unset and all tasks run here, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{named or tempfile.mkdtemp()}/{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """df, written to a folder that all tasks share and read again: its values are computed once, whatever reads them."""
    path = f"{shared_dir(df.sparkSession)}/{label}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def redacted(c: Column) -> Column:
    return F.regexp_replace(c, PRIVATE, PLACEHOLDER)


def publishable(counts: DataFrame, column: str, least: int) -> DataFrame:
    """Aggregates that rest on at least `least` documents; no row-level output."""
    return counts.filter(F.col(column) >= least)
