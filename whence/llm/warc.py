"""WARC archives with a two-level capture index.

Writing: every page is a gzip member of its own in a ``.warc.gz`` file.  Of pages with equal
payloads of ``LEAST`` bytes or more, the one with the smallest page_id is a ``response``, the others are
``revisit`` records that name it and hold no payload.  A task writes files of its own name into the
shared folder, so what a lost task has left behind is named by nobody.

Index: a capture's key is its URL with the host reversed (``com,example,www)/path``) and its page_id.
Sorted by key, captures become compressed blocks of ``BLOCK`` lines in one file for each range, at whose
end a sparse directory has the first key of every block; the first keys of the files, one for
each range, are all that the driver sees.  A look-up bisects the files, the file's directory, then the
lines of a block, and range-reads block and record.

Reading: archives are streamed record by record; payload sizes and digests are taken from
the payloads.  A revisit's payload is the one of the response it names, found through the index;
revisits are sorted by the response's key first, so neighbours share blocks and records, and one
very common payload is spread over many tasks.

The folder is opened with pyarrow's file systems (file, hdfs, s3, gs).  Null and empty pages have an
empty payload; a null url has an empty one.  Null page_ids come last, so they are a response only
among themselves, and are referred to as null.  Repeated rows: rows that share the smallest page_id of a payload are
repetitions of one capture and all responses.  Control characters of a url are percent-encoded in
the archive.  Texts of any length are one record; empty tables give an empty result.  Only
``page_id``, ``url`` and ``html`` are read, other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whence.llm.common import batch_of, batches, spread, texts
from whence.session import shared_folder, stored

#: Smallest payload that is stored once; compressed bytes of an archive; captures of an index block; level of gzip.
LEAST, ARCHIVE_BYTES, BLOCK, LEVEL = 100, 32 << 20, 3000, 5
#: Date of the records: pages carry none.
DATE = "2000-01-01T00:00:00Z"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_CHUNK = 1 << 16
_END = b"\r\n\r\n"


def opened(folder: str) -> tuple[FileSystem, str]:
    fs, path = FileSystem.from_uri(folder)
    return fs, path.rstrip("/")


def surt(url: str) -> str:
    """``https://www.example.com:81/a?b#c`` as ``com,example,www:81)/a?b``."""
    rest = url.split("#", 1)[0]
    rest = rest.split("://", 1)[1] if "://" in rest else rest
    cut = re.search(r"[/?]", rest)
    host, path = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "/")
    name, colon, port = host.rpartition("@")[2].lower().partition(":")
    return f"{','.join(reversed(name.split('.')))}{colon}{port}){path}"


def capture_key(url: str, page_id: int | None) -> str:
    """Sorted by reversed host, path and page_id."""
    return f"{surt(url)} {'~' if page_id is None else format(page_id + (1 << 63), '020d')}"


def _named(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _number(name: str) -> int | None:
    text = name[len("<urn:page:") : -1]
    return int(text) if text else None


def record(page_id: int | None, url: str, payload: bytes, digest: str, of: tuple[int | None, str] | None) -> bytes:
    """One WARC record; ``of`` is the (page_id, url) that a revisit refers to."""
    kind = "response" if of is None else "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if of is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_named(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}",
             f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if of is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {_named(of[0])}", f"WARC-Refers-To-Target-URI: {of[1]}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + _END + block + _END


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    cut = raw.index(_END)
    version, *lines = raw[:cut].decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    start, size = cut + len(_END), int(fields["Content-Length"])
    if not version.startswith("WARC/") or raw[start + size :] != _END:
        raise ValueError("not a WARC record")
    block = raw[start : start + size]
    return fields, block[block.index(_END) + len(_END) :]


def _printable(url: str | None) -> str:
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")


def planned(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, first): ``first`` is the (page_id, url) of the response that the page repeats, or null."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    known = rows.where(F.octet_length("html") >= LEAST)
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    groups = known.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = spread(groups.select("digest", F.struct("first.page_id", "first.url").alias("first")), "digest")
    joined = spread(rows, "digest").join(groups, ["digest", "_spread"], "left")
    own = F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return joined.select("page_id", "url", "html", "digest", F.when(~own, F.col("first")).alias("first"))


_CAPTURE = pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("digest", pa.string())])
_CAPTURE_DDL = "key string, file string, offset long, length long, kind string, digest string"


def written(plan: DataFrame, folder: str) -> DataFrame:
    """Write the archives; (key, file, offset, length, kind, digest) of every record."""

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        out, name, at = None, "", 0
        try:
            for b in batches(it):
                rows = []
                for page_id, url, html, digest, first in zip(b.column("page_id").to_pylist(), texts(b, "url"), texts(b, "html"), b.column("digest").to_pylist(), b.column("first").to_pylist()):
                    if out is None:
                        name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    of = None if first is None else (first["page_id"], _printable(first["url"]))
                    url = _printable(url)
                    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = pack.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, of)) + pack.flush()
                    out.write(member)
                    rows.append((capture_key(url, page_id), name, at, len(member), "response" if of is None else "revisit", digest))
                    at += len(member)
                    if at >= ARCHIVE_BYTES:
                        out.close()
                        out = None
                yield batch_of(_CAPTURE, [list(c) for c in zip(*rows)])
        finally:
            if out is not None:
                out.close()

    return plan.mapInArrow(part, _CAPTURE_DDL)


_RANGE = pa.schema([("first", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())])


def indexed(captures: DataFrame, folder: str) -> DataFrame:
    """Write the index; one row (first, file, at, size) for each file: its first key and where its directory is."""

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        out, name, at, lines, directory = None, f"index-{uuid.uuid4().hex}.cdx.zst", 0, [], []

        def flush() -> None:
            nonlocal out, at, lines
            out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
            data = zstandard.compress("\n".join(json.dumps(x) for x in lines).encode("utf-8", "surrogatepass"), 3)
            directory.append((lines[0][0], at, len(data)))
            out.write(data)
            at, lines = at + len(data), []

        for b in batches(it):
            for row in zip(*(b.column(c).to_pylist() for c in _CAPTURE.names)):
                lines.append(row)
                if len(lines) == BLOCK:
                    flush()
        if lines:
            flush()
        if out is not None:
            data = zstandard.compress(json.dumps(directory).encode("utf-8", "surrogatepass"), 3)
            out.write(data)
            out.close()
            yield batch_of(_RANGE, ([directory[0][0]], [name], [at], [len(data)]))

    ranges = captures.repartitionByRange("key").sortWithinPartitions("key")
    return ranges.mapInArrow(part, "first string, file string, at long, size long")


@dataclass(frozen=True)
class Index:
    """The archives' folder and the first keys of the index files, as many as the index has ranges."""

    folder: str
    files: list[tuple[str, str, int, int]]

    def reader(self) -> Reader:
        return Reader(self)


class Reader:
    """Look-ups in an index; the last directory, block and record are kept for the next one."""

    def __init__(self, index: Index):
        self.fs, self.base = opened(index.folder)
        self.files, self.firsts = index.files, [f[0] for f in index.files]
        self.held: dict[str, tuple[tuple, object]] = {}

    def _range(self, kind: str, name: str, at: int, size: int):
        if self.held.get(kind, ((),))[0] != (name, at):
            with self.fs.open_input_file(f"{self.base}/{name}") as f:
                f.seek(at)
                raw = f.read(size)
            if kind == "record":
                made = parsed(zlib.decompress(raw, 31))
            else:
                data = zstandard.decompress(raw).decode("utf-8", "surrogatepass")
                made = json.loads(data) if kind == "directory" else [json.loads(x) for x in data.split("\n")]
            self.held[kind] = ((name, at), made)
        return self.held[kind][1]

    def captures(self, prefix: str) -> Iterator[list]:
        """The index lines whose key starts with ``prefix``, in order."""
        for k in range(max(0, bisect_left(self.firsts, prefix) - 1), len(self.files)):
            first, name, at, size = self.files[k]
            if first > prefix and not first.startswith(prefix):
                return
            directory = self._range("directory", name, at, size)
            starts = [d[0] for d in directory]
            for first, at, size in directory[max(0, bisect_left(starts, prefix) - 1) :]:
                if first > prefix and not first.startswith(prefix):
                    return
                lines = self._range("block", name, at, size)
                keys = [x[0] for x in lines]
                for line in lines[bisect_left(keys, prefix) :]:
                    if not line[0].startswith(prefix):
                        break
                    yield line

    def payload(self, line: list) -> bytes:
        """The payload of a response, read from its place in the archive."""
        return self._range("record", *line[1:4])[1]

    def response(self, key: str, digest: str) -> bytes:
        """The payload of the response with this key; an error if the archives don't hold it."""
        for line in self.captures(key):
            if line[0] == key and line[4] == "response" and line[5] == digest:
                return self.payload(line)
        raise LookupError(f"no response {key!r} with digest {digest}")


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target", pa.string())])
_READ_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string"


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other."""
    raw, unpack, held = b"", zlib.decompressobj(31), []
    while raw or (raw := stream.read(_CHUNK)):
        held.append(unpack.decompress(raw))
        raw = unpack.unused_data
        if unpack.eof:
            yield b"".join(held)
            unpack, held = zlib.decompressobj(31), []
    if held:
        raise ValueError("the archive ends within a record")


def streamed(files: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives; of a revisit, ``target`` is the key of the response and the size is null."""

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        for b in batches(it):
            for name in b.column("file").to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for raw in members(f):
                        fields, payload = parsed(raw)
                        kind, page_id = fields["WARC-Type"], _number(fields["WARC-Record-ID"])
                        if kind == "revisit":
                            to = _number(fields["WARC-Refers-To"])
                            target = capture_key(fields["WARC-Refers-To-Target-URI"], to)
                            rows.append((page_id, None, fields["WARC-Payload-Digest"].removeprefix("sha256:"), kind, to, target))
                        else:
                            rows.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), kind, None, None))
                        if len(rows) >= 10_000:
                            yield batch_of(_READ, [list(c) for c in zip(*rows)])
                            rows = []
                if rows:
                    yield batch_of(_READ, [list(c) for c in zip(*rows)])

    return files.mapInArrow(part, _READ_DDL)


def resolved(revisits: DataFrame, index: Index, tasks: int) -> DataFrame:
    """Revisits with the size and digest of the payload they stand for."""

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = index.reader()
        last, size, digest = None, 0, ""
        for b in batches(it):
            rows = []
            for page_id, _, told, kind, to, target in zip(*(b.column(c).to_pylist() for c in _READ.names)):
                if (target, told) != last:
                    payload = reader.response(target, told)
                    last, size, digest = (target, told), len(payload), hashlib.sha256(payload).hexdigest()
                rows.append((page_id, size, digest, kind, to, target))
            yield batch_of(_READ, [list(c) for c in zip(*rows)])

    ordered = revisits.repartitionByRange(tasks, "target", "page_id").sortWithinPartitions("target", "page_id")
    return ordered.mapInArrow(part, _READ_DDL)


def archived(pages: DataFrame) -> tuple[DataFrame, Index]:
    """Write archives and index of ``pages`` into the shared folder: (captures, index)."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    fs, base = opened(folder)
    fs.create_dir(base, recursive=True)
    captures = stored(written(planned(pages), folder), "captures")
    files = stored(indexed(captures, folder), "capture-ranges").orderBy("first", "file").toLocalIterator()
    return captures, Index(folder, [tuple(r) for r in files])


def found(urls: DataFrame, index: Index) -> DataFrame:
    """(url, page_id, record_type, digest, file, offset): all captures of each row of ``urls(url)``, by look-ups in the index."""
    out = pa.schema([("url", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("digest", pa.string()), ("file", pa.string()), ("offset", pa.int64())])

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = index.reader()
        for b in batches(it):
            rows = []
            for url in b.column("url").to_pylist():
                for key, name, at, _, kind, digest in reader.captures(f"{surt(_printable(url))} "):
                    number = key.rpartition(" ")[2]
                    rows.append((url, None if number == "~" else int(number) - (1 << 63), kind, digest, name, at))
            if rows:
                yield batch_of(out, [list(c) for c in zip(*rows)])

    return urls.select("url").mapInArrow(part, "url string, page_id long, record_type string, digest string, file string, offset long")


def read_back(captures: DataFrame, index: Index) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in the archives."""
    files = captures.select("file").distinct()
    tasks = max(1, files.count())  # names are small, so what they stand for has to decide the number of tasks
    rows = stored(streamed(files.repartition(tasks), index.folder), "records")
    whole = rows.where("record_type = 'response'").unionAll(resolved(rows.where("record_type = 'revisit'"), index, tasks))
    return whole.drop("target")
