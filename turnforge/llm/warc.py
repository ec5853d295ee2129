"""WARC archives with a two-level capture index.

Write: one gzip member per record, in archives of the shared folder.  Of pages with
equal payloads of at least ``least_bytes`` the one with the largest id is a
`response`; the others are `revisit` records that refer to it.

Index: captures are range-sorted by reversed-host key and id.  Each part of the range
is a file of compressed blocks of ``BLOCK_LINES`` lines, followed by its sparse
directory, one line per block (first key, offset, length).  A manifest has one row per
part; its size is the number of shuffle partitions, and it is the only thing
that tasks get whole.

Look up: queries are range-sorted too.  A task finds a key's part in the manifest and its
block in that part's directory by binary search, reads that block's byte range,
finds the line by binary search, and reads the record's byte range.  Tasks are dealt by the bytes
of the archives, not by those of the narrow keys.

Files are written and read through ``pyarrow.fs`` by URI, so the folder may be a mounted
path or a store that it knows.  A task's attempt writes files of its own; only
those that a committed table names are ever read, so lost executors and
repeated tasks do no harm.

Cases: a null html is an empty payload; a null url is the empty key; control characters in
urls are percent-encoded in records; a null id sorts before all others; rows that
repeat the id and url of a response are responses too; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnforge.llm.common import scratch_path, stored

BLOCK_LINES = 1000
ARCHIVE_BYTES = 1 << 30
READ_BYTES = 1 << 22  # of archives, for a task to read
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "key string, page_id long, file string, offset long, length long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"
NO_ID = -(1 << 70)


def at_uri(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def reversed_host(url: str | None) -> str:
    """`com,example,www)/path?query`; text that is no URL is its own key."""
    try:
        parts = urlsplit(url or "")
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url or ""
    if not host:
        return url or ""
    where = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{where}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _encoded(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """An uncompressed record; a revisit has the HTTP head only."""
    block = HTTP.format(len(payload)).encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_encoded(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parse(raw: bytes) -> tuple[dict, bytes]:
    """What a record says, and its payload; raises if lengths or digest are wrong."""
    head, rest = raw.split(b"\r\n\r\n", 1)
    warc = _fields(head)
    block = rest[:int(warc["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("the record is not as long as it says")
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(_fields(http)["Content-Length"])
    digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = warc["WARC-Type"]
    if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError("the payload is not what the record says")
    number = lambda field: int(x) if (x := warc.get(field, "").removeprefix("<urn:page:").removesuffix(">")) else None
    return {"page_id": number("WARC-Record-ID"), "url": warc.get("WARC-Target-URI"), "record_type": kind, "refers_to": number("WARC-Refers-To"), "payload_digest": digest, "payload_bytes": size}, payload


def _write(root: str):
    def write(batches):
        files, where = at_uri(root)
        out, name, offset = None, "", 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or offset >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    files.create_dir(where, recursive=True)
                    name, offset = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{where}/{name}", compression=None)
                member = gzip.compress(record(r["page_id"], r["url"], (r["html"] or "").encode(), r["refers_to"], r["refers_to"] is not None), LEVEL, mtime=0)
                out.write(member)
                rows.append((reversed_host(r["url"]), r["page_id"], name, offset, len(member)))
                offset += len(member)
            if rows:
                yield _batch(rows, ("key", "page_id", "file", "offset", "length"), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))
        if out is not None:
            out.close()
    return write


def _batch(rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def write_archives(pages: DataFrame, root: str, least_bytes: int = 0) -> DataFrame:
    """Writes a record per page below ``root``; returns the captures (key, page_id, file, offset, length), a written table."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    body = F.coalesce("html", F.lit("")).cast("binary")
    known = pages.withColumn("digest", F.sha1(body)).withColumn("size", F.length(body))
    same = (known.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("copies"))
            .where("copies > 1").select(F.col("digest").alias("d"), F.col("size").alias("s"), "first"))
    same = stored(same, "payloads")  # narrow; Spark broadcasts it if its size allows, so that no html is shuffled
    known = known.join(same, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    again = F.col("first").isNotNull() & ~F.struct("page_id", "url").eqNullSafe(F.struct("first.page_id", "first.url"))
    return stored(known.select("page_id", "url", "html", F.when(again, F.col("first.page_id")).alias("refers_to")).mapInArrow(_write(root), CAPTURES), "captures")


def _sort_key(key: str, page_id: int | None) -> tuple:
    return key, NO_ID if page_id is None else page_id


def _write_index(root: str):
    def write(batches):
        files, where = at_uri(root)
        out, name, offset = None, f"part-{uuid.uuid4().hex}.idx", 0
        directory, lines = [], []

        def end_block():
            nonlocal offset, lines
            first = json.loads(lines[0])[:2]
            block = zlib.compress("\n".join(lines).encode(), LEVEL)
            out.write(block)
            directory.append([*first, offset, len(block)])
            offset += len(block)
            lines = []

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    files.create_dir(where, recursive=True)
                    out = files.open_output_stream(f"{where}/{name}", compression=None)
                lines.append(json.dumps(r))
                if len(lines) == BLOCK_LINES:
                    end_block()
        if out is not None:
            if lines:
                end_block()
            sparse = zlib.compress("\n".join(map(json.dumps, directory)).encode(), LEVEL)
            out.write(sparse)
            out.close()
            yield _batch([(*directory[0][:2], name, offset, len(sparse))], ("key", "page_id", "file", "offset", "length"), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))
    return write


def write_index(captures: DataFrame, root: str) -> list[tuple]:
    """Writes the index below ``root``; returns the manifest: (first key, first id, file, offset and length of the directory) of each part, in order."""
    order = ("key", "page_id")
    parts = captures.select("key", "page_id", "file", "offset", "length").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_write_index(root), CAPTURES)
    return sorted((tuple(r) for r in stored(parts, "index-parts").collect()), key=lambda r: _sort_key(r[0], r[1]))


class Reader:
    """Byte ranges of files below a folder; keeps a few files open."""

    def __init__(self, root: str, keep: int = 32):
        self.files, self.where = at_uri(root)
        self.keep, self.open = keep, OrderedDict()

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= self.keep:
                self.open.popitem(last=False)[1].close()
            self.open[name] = self.files.open_input_file(f"{self.where}/{name}")
        self.open.move_to_end(name)
        file = self.open[name]
        file.seek(offset)
        got = file.read(length)
        if len(got) != length:
            raise ValueError(f"{name} ends before {offset + length}")
        return got


class Index:
    """Binary search in manifest, directory and block; keeps the last directory and block."""

    def __init__(self, root: str, manifest: list[tuple]):
        self.reader, self.manifest = Reader(root), manifest
        self.firsts = [_sort_key(m[0], m[1]) for m in manifest]
        self.part = self.block = None
        self.directory: list = []
        self.lines: list = []

    def _load(self, part: int):
        if part != self.part:
            _, _, file, offset, length = self.manifest[part]
            self.directory = [json.loads(x) for x in zlib.decompress(self.reader.read(file, offset, length)).decode().split("\n")]
            self.part, self.block = part, None

    def _block(self, part: int, block: int) -> list:
        self._load(part)
        if block != self.block:
            _, _, offset, length = self.directory[block]
            self.lines = [json.loads(x) for x in zlib.decompress(self.reader.read(self.manifest[part][2], offset, length)).decode().split("\n")]
            self.block = block
        return self.lines

    def find(self, key: str, page_id: int | None) -> Iterator[list]:
        """All captures (key, page_id, file, offset, length) of the key and id."""
        wanted = _sort_key(key, page_id)
        part = max(bisect_left(self.firsts, wanted) - 1, 0)  # the last that begins before the key
        while part < len(self.manifest) and self.firsts[part] <= wanted:
            self._load(part)
            firsts = [_sort_key(d[0], d[1]) for d in self.directory]
            block = max(bisect_left(firsts, wanted) - 1, 0)
            while block < len(firsts) and firsts[block] <= wanted:
                lines = self._block(part, block)
                keys = [_sort_key(x[0], x[1]) for x in lines]
                for k in range(bisect_left(keys, wanted), len(keys)):
                    if keys[k] != wanted:
                        break
                    yield lines[k]
                block += 1
            part += 1


def _look_up(archives: str, root: str, manifest: list[tuple]):
    def look_up(batches):
        index, reader = Index(root, manifest), Reader(archives)
        names = [f.split()[0] for f in RECORDS.split(", ")]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
        for batch in batches:
            rows = []
            for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for _, _, file, offset, length in index.find(key, page_id):
                    said, _ = parse(gzip.decompress(reader.read(file, offset, length)))
                    rows.append(tuple(said[n] for n in names))
            if rows:
                yield _batch(rows, tuple(names), kinds)
    return look_up


def _keys(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([reversed_host(u) for u in batch.column(1).to_pylist()], pa.string()), batch.column(0)], ["key", "page_id"])


def reading_tasks(captures: DataFrame) -> int:
    """Tasks to read all ``captures``: one for each ``READ_BYTES``, at most the number of shuffle partitions."""
    size = captures.agg(F.sum("length")).first()[0] or 0
    return max(1, min(-(-size // READ_BYTES), int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def look_up(queries: DataFrame, archives: str, root: str, manifest: list[tuple], tasks: int | None = None) -> DataFrame:
    """Records (page_id, url, record_type, refers_to, payload_digest, payload_bytes) captured for the (page_id, url) of ``queries``, each once; by ``tasks`` tasks if given."""
    keys = queries.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(_keys, "key string, page_id long").distinct()
    order = ("key", "page_id")
    dealt = keys.repartitionByRange(tasks, *order) if tasks else keys.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order).mapInArrow(_look_up(archives, root, manifest), RECORDS)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes and indexes the pages in a fresh folder, then reads every page's record back through the index."""
    root = scratch_path(pages.sparkSession, "warc")
    captures = write_archives(pages, f"{root}/archives", least_bytes)
    manifest = write_index(captures, f"{root}/index")
    return look_up(pages, f"{root}/archives", f"{root}/index", manifest, reading_tasks(captures))
