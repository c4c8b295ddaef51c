"""Web archives: ARC files of either version, their conversion to WARC with revisits, and a WARC reader."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from datetime import UTC, datetime
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .scratch import Scratch

#: Bytes after which a task begins a new file, and the compression level of records.
FILE_BYTES, LEVEL = 64 << 20, 3
#: Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_HEADER = b"X-Page-Id"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _field(text: str | None) -> str:
    """A header value without white space or control characters of any script; those are percent-encoded as UTF-8."""
    return "".join(quote(c, safe="") if c.isspace() or not c.isprintable() else c for c in text) if text else "-"


def http_response(page_id: int | None, payload: bytes) -> bytes:
    own = b"" if page_id is None else ID_HEADER + b": %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n%s\r\n" % (len(payload), own) + payload


def split_http(block: bytes) -> tuple[bytes, bytes, dict[bytes, bytes]]:
    """Head with its blank line, body, and headers by lower-case name; of a block that is no HTTP message, all is body."""
    if not block.startswith(b"HTTP/"):
        return b"", block, {}
    head, mark, body = block.partition(b"\r\n\r\n")
    headers = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:]))
    return head + mark, body, headers


class Rolling:
    """Writes records, each a gzip member, to files of about FILE_BYTES."""

    def __init__(self, folder: str, stem: str, suffix: str, begin):
        self.folder, self.stem, self.suffix, self.begin, self.out, self.done = folder, stem, suffix, begin, None, []

    def add(self, record: bytes) -> None:
        if self.out is not None and self.size >= FILE_BYTES:
            self.close()
        if self.out is None:
            self.uri, self.out = files.create(self.folder, self.stem, self.suffix)
            self.size, self.records = self.out.write(_member(self.begin(self.uri.rpartition("/")[2]))), 0
        self.size += self.out.write(_member(record))
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.uri, self.records))
            self.out = None

    def table(self) -> pa.RecordBatch:
        self.close()
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in self.done], pa.string()), pa.array([n for _, n in self.done], pa.int64())], ["path", "records"])


def arc_head(version: int, date: str, name: str) -> bytes:
    body = f"{version} 0 poolscope\n{ARC_FIELDS[version]}\n\n".encode()
    values = {1: f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}", 2: f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}"}
    return values[version].encode() + b"\n" + body + b"\n"


def _write_arc(batches, folder: str, date: str):
    from pyspark import TaskContext

    version = TaskContext.get().partitionId() % 2 + 1
    out = Rolling(folder, f"v{version}", ".arc.gz", partial(arc_head, version, date))
    for batch in batches:
        for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            block = http_response(page, (html or "").encode())
            rest = f"{len(block)}" if version == 1 else f"200 {sha1(block)} - 0 {out.stem} {len(block)}"
            out.add(f"{_field(url)} 0.0.0.0 {date} text/html {rest}\n".encode() + block + b"\n")
    yield out.table()


class Damaged(ValueError):
    """An archive that can't be read on from here."""


def parse_arc(raw):
    """(fields by name, block) of each record of an uncompressed ARC stream after its version block.

    The version block's own lines tell the version and the fields of every header line; a line is split at spaces from its end, so that a URL may hold
    some. A record's bytes are counted by its declared length, so what the block holds doesn't matter. What can't be so read raises Damaged, since
    nothing then tells where the next record begins.
    """
    first = raw.readline().split()
    if not first or not first[0].startswith(b"filedesc:") or not first[-1].isdigit():
        raise Damaged("an ARC file begins with its filedesc record")
    head = raw.read(int(first[-1])).split(b"\n")
    version, names = head[0].split()[:1], head[1].decode("utf-8", "replace").split() if len(head) > 1 else []
    if not version or not version[0].isdigit() or ARC_FIELDS.get(int(version[0])) != " ".join(names):
        raise Damaged(f"version {version} with fields {names}")
    while line := raw.readline():
        if not line.strip():
            continue
        values = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
        if len(values) != len(names):
            raise Damaged(f"{len(values)} fields where {len(names)} are declared")
        fields = dict(zip(names, values, strict=True))
        if not fields["Archive-length"].isdecimal():
            raise Damaged(f"the length {fields['Archive-length'][:40]!r}")
        block = raw.read(int(fields["Archive-length"]))
        if len(block) != int(fields["Archive-length"]):
            raise Damaged("a record ends before its declared length")
        yield fields, block


def readable(path: str):
    """(place, fields, block, error) of each record of an ARC file; where it is damaged, a last one that has the error alone."""
    k = -1
    try:
        with gzip.open(files.stream(path)) as raw:
            for k, (fields, block) in enumerate(parse_arc(raw)):
                yield k, fields, block, None
    except (Damaged, EOFError, gzip.BadGzipFile, zlib.error) as e:
        yield k + 1, None, None, f"{type(e).__name__}: {e}"


def _number(text: str | bytes | None) -> int | None:
    """A decimal number of 64 bits; None for anything else."""
    text = text.decode("latin-1") if isinstance(text, bytes) else text or ""
    sign = text.startswith("-")
    if not (text[sign:].isascii() and text[sign:].isdigit()) or len(text) > 20:
        return None
    return n if -(2**63) <= (n := int(text)) < 2**63 else None


def page_of(headers: dict[bytes, bytes]) -> int | None:
    return _number(headers.get(ID_HEADER.lower()))


INDEX = "path string, k long, page_id long, payload_bytes long, digest string, error string"


def _index_arc(batches):
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows = []
            for k, _, block, error in readable(path):
                if error:
                    rows.append((path, k, None, None, None, error))
                else:
                    _, payload, headers = split_http(block)
                    rows.append((path, k, page_of(headers), len(payload), sha1(payload), None))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])


def record_id(path: str, k: int) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{path}#{k}"))


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def warc_date(date: str) -> str:
    """An ARC date of 14 digits, or fewer of an earlier part; what is no date becomes the beginning of 1970."""
    try:
        return datetime.strptime((date + "00000101000000"[len(date) :])[:14], "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def to_warc(path: str, k: int, fields: dict, block: bytes, refers_to: str | None) -> bytes:
    """The WARC record of an ARC record: a response of an HTTP message, a resource of anything else (dns, ftp), under its declared type, or with refers_to
    a revisit, which keeps the HTTP head alone."""
    head, payload, _ = split_http(block)
    kept = block if refers_to is None else head
    kind = "revisit" if refers_to is not None else "response" if head else "resource"
    content = "application/http;msgtype=response" if head else _field(fields["Content-type"])
    headers = [("WARC-Record-ID", f"<urn:uuid:{record_id(path, k)}>"), ("WARC-Date", warc_date(fields["Archive-date"])), ("WARC-Target-URI", _field(fields["URL"])), ("WARC-IP-Address", _field(fields["IP-address"]))]
    headers += [("WARC-Payload-Digest", f"sha1:{sha1(payload)}"), (SIZE_HEADER, str(len(payload))), ("WARC-Block-Digest", f"sha1:{sha1(kept)}"), ("Content-Type", content)]
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<urn:uuid:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    return warc_record(kind, headers, kept)


def _info(name: str) -> bytes:
    own = uuid.uuid5(uuid.NAMESPACE_URL, name)
    return warc_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def _convert(batches, folder: str):
    out = Rolling(folder, "converted", ".warc.gz", _info)
    for batch in batches:
        for path, revisits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            refers = {x["k"]: record_id(x["to_path"], x["to_k"]) for x in revisits or ()}
            for k, fields, block, error in readable(path):
                if not error:
                    out.add(to_warc(path, k, fields, block, refers.get(k)))
    yield out.table()


#: How long a record's payload is, which a revisit leaves out.
SIZE_HEADER = "Payload-Length"


def parse_warc(raw):
    """(headers, block) of each record of an uncompressed WARC stream; what can't be so read raises Damaged."""
    while line := raw.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise Damaged("a WARC record begins with its version")
        headers = {}
        while (line := raw.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip()] = v.strip()
        length = _number(headers.get("Content-Length"))
        if length is None or length < 0:
            raise Damaged(f"the length {headers.get('Content-Length', '')[:40]!r}")
        block = raw.read(length)
        if len(block) != length:
            raise Damaged("a record ends before its declared length")
        yield headers, block


WARC_ROWS = "record_id string, record_type string, refers_to_id string, url string, date string, page_id long, payload_bytes long, payload_digest string, path string, error string"


def _warc_row(path: str, headers: dict, block: bytes) -> tuple | None:
    bare = lambda x: x.strip("<>").removeprefix("urn:uuid:") if x else None
    kind, error = headers.get("WARC-Type"), None
    if kind not in ("response", "revisit", "resource"):
        return None
    _, payload, http = split_http(block)
    digest = headers.get("WARC-Payload-Digest", "").partition(":")[2] or None
    size = len(payload)
    if kind != "revisit":
        own = sha1(payload)
        error = None if digest in (None, own) else f"the payload's digest is {own}, declared {digest}"
        digest = own
    else:
        # what a revisit leaves out is as long as its record says, else its HTTP head, which may be wrong, or silent as of a chunked message
        size = next((n for x in (headers.get(SIZE_HEADER), http.get(b"content-length")) if (n := _number(x)) is not None and n >= 0), None)
    return bare(headers.get("WARC-Record-ID")), kind, bare(headers.get("WARC-Refers-To")), headers.get("WARC-Target-URI"), headers.get("WARC-Date"), page_of(http), size, digest, path, error


def _read_warc(batches):
    kinds = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.string()] * 3
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows = []
            try:
                with gzip.open(files.stream(path)) as raw:
                    for headers, block in parse_warc(raw):
                        if row := _warc_row(path, headers, block):
                            rows.append(row)
            except (Damaged, EOFError, gzip.BadGzipFile, zlib.error) as e:
                rows.append((*[None] * 8, path, f"{type(e).__name__}: {e}"))
            columns = list(zip(*rows, strict=True)) or [()] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in WARC_ROWS.split(", ")])


def write_arc(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20200101000000") -> DataFrame:
    """ARC files, version 1 and 2 by turns, of rows of pages: (path, records)."""
    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return scratch.keep(rows.mapInArrow(partial(_write_arc, folder=scratch.path("arc"), date=date), "path string, records long"), "arc-files")


def arc_to_warc(arcs: DataFrame, scratch: Scratch, least: int = 0) -> DataFrame:
    """WARC files, (path, records), of the ARC files in column path.

    Header lines are parsed by the version that a file's first record declares, blocks by their declared lengths. Identifiers come from the place of a
    record, dates, types and digests from its fields and bytes. Of records with equal payloads of at least `least` bytes, that with the smallest page id
    (nulls last, then by place) is the response; the others revisit it. Groups of equal payloads meet as digests only, after a partial aggregation.
    A damaged file is converted up to its damage; damaged() has a row for it.
    """
    many = 2 * max(1, arcs.count())  # files are dealt by number: their names say nothing of their sizes
    paths = arcs.select("path").repartition(many, "path")
    index = scratch.keep(paths.mapInArrow(_index_arc, INDEX), "arc-index")
    whole = index.filter("error is null").drop("error")
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "path", "k")
    first = scratch.keep(whole.filter(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.min(place).alias("to"), F.count("*").alias("n")).filter("n > 1"), "responses")
    # all rows of a common payload meet its one response: a join of its own, whose large keys can be split
    revisits = whole.hint("merge").join(first, ["digest", "payload_bytes"]).filter("path <> to.path or k <> to.k")
    revisits = revisits.groupBy("path").agg(F.collect_list(F.struct("k", F.col("to.path").alias("to_path"), F.col("to.k").alias("to_k"))).alias("revisits"))
    work = paths.join(revisits, "path", "left").repartition(many, "path")
    return scratch.keep(work.mapInArrow(partial(_convert, folder=scratch.path("warc")), "path string, records long"), "warc-files")


def damaged(scratch: Scratch) -> DataFrame:
    """path, k, error: the files that arc_to_warc() could not read to their end, and how many records came before."""
    return scratch.again("arc-index", INDEX).filter("error is not null").select("path", "k", "error")


def read_warc(warcs: DataFrame) -> DataFrame:
    """One row per response, resource or revisit of the WARC files in column path, own ones or foreign.

    payload_bytes of a revisit: what its record declares, else its HTTP head, null where neither does. payload_digest: of the payload itself, of a revisit
    as declared. page_id: null where the HTTP head names none of 64 bits. error: where a response's payload has another digest than declared; a file that is
    damaged has a last row with path and error alone.
    """
    return warcs.select("path").repartition(2 * max(1, warcs.count()), "path").mapInArrow(_read_warc, WARC_ROWS)


def archive(pages: DataFrame, least: int = 0, **columns) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, read back from the WARC files that its ARC record was converted to.

    html null: an empty payload. url null or empty: "-"; white space and control characters in it are percent-encoded. page_id null: the record has none, and counts as the largest.
    Rows that repeat a page_id are records of their own. An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "archive")
    warcs = arc_to_warc(write_arc(pages, scratch, **columns), scratch, least)
    broken = damaged(scratch).count()
    if broken:
        raise OSError(f"{broken} of the archives just written are damaged")
    rows = scratch.keep(read_warc(warcs), "records")
    wrong = rows.filter("error is not null").select("path", "error").limit(1).collect()
    if wrong:
        raise OSError(f"{wrong[0]['path']}, just written: {wrong[0]['error']}")
    scratch.drop("arc", "arc-files", "arc-index", "responses", "warc", "warc-files")
    responses = rows.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    plain, linked = rows.filter("refers_to_id is null").withColumn("refers_to", F.lit(None).cast("long")), rows.filter("refers_to_id is not null").join(responses, "refers_to_id")
    return plain.unionByName(linked).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "date", "record_id")
