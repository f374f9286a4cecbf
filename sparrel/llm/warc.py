"""WARC archives with a two-level capture index (operator 6).

Pages become gzip members of .warc.gz files in the shared folder: a response for
the first page with a payload, revisits that refer to it for the others. Captures
are sorted by their URL with the host reversed, and lie in compressed blocks of
index files, one for each range of keys. An index file ends with a sparse directory
of its blocks (first key, place, length); the list of index files with their first
keys is the upper level. A search is two binary searches, one read of a block, and
one read of a record. Many searches are one job: keys go to the files that a binary
search of the upper level names, are looked up there in order, so that each block is
read once, and the records that they name are read archive by archive.

A task writes files under a name of its own and returns their index rows, so a task
that is run again leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, if_small, shared_dir, ship
from .store import reader, writer

BLOCK_LINES = 3000
ARCHIVE_BYTES = 1_000_000_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The last bytes of an index file: where its directory begins, in decimal.
TAIL = 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Host reversed and joined by commas, then ')' and the rest; scheme and fragment are dropped."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return "-" + url
    if not host:
        return "-" + url
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + tail


def record(page_id, url: str | None, payload: bytes, kind: str, refers_to, date: str = DATE) -> bytes:
    """A WARC record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url or '', safe=_SAFE)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_SAFE = "".join(chr(c) for c in range(33, 127))


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and payload of a record."""
    end = data.index(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in data[:end].decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = data[end + 4 : end + 4 + int(fields["content-length"])]
    return fields, block[block.index(b"\r\n\r\n") + 4 :]


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """(id, url, payload, kind, refers_to): of equal payloads of ``least`` bytes or more the smallest id is the response.

    Payloads that several rows have are few enough to be broadcast, as a rule, so that no
    payload is shuffled. NULL html is an empty payload. Repeated rows of the smallest id are responses
    all of them. Where all ids of a payload are NULL, all are responses.
    """
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), F.coalesce(pages[html_col], F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    firsts = rows.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    got = rows.join(if_small(cut(firsts, "repeated-payloads")), "sha", "left")
    again = (F.length("payload") >= least) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return got.select("id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Write archives and return their captures: (key, id, archive, offset, length), a stored table."""

    def run(batches):
        out, name, size = None, "", 0
        try:
            for batch in batches:
                rows: tuple[list, ...] = ([], [], [], [], [])
                for page_id, url, payload, kind, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or size > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                        out = writer(name)
                    press = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = press.compress(record(page_id, url, payload, kind, first)) + press.flush()
                    out.write(data)
                    for column, value in zip(rows, (url_key(url), page_id, name, size, len(data)), strict=True):
                        column.append(value)
                    size += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], batch.column(0).type), *(pa.array(r, t) for r, t in zip(rows[2:], (pa.string(), pa.int64(), pa.int64()), strict=True))], ["key", "id", "archive", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    ship(records.sparkSession)
    return cut(records.mapInArrow(run, f"key string, id {records.schema['id'].dataType.simpleString()}, archive string, offset long, length long"), "captures")


def write_index(captures: DataFrame, folder: str, files: int | None = None, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write index files and return the upper level: (first_key, last_key, file, n), a stored table.

    Rows are ranged by key and id, so that one URL with very many captures is split.
    """
    files = files or int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        out, name, at, first, key, n, directory, lines = None, "", 0, None, None, 0, [], []

        def flush():
            nonlocal at, lines
            data = zlib.compress("\n".join(lines).encode(), 6)
            out.write(data)
            directory.append((json.loads(lines[0])[0], at, len(data)))
            at, lines = at + len(data), []

        for batch in batches:
            for key, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, first = f"{folder}/{uuid.uuid4().hex}.idx", key
                    out = writer(name)
                lines.append(json.dumps([key, *rest]))
                n += 1
                if len(lines) == block_lines:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.write(zlib.compress(json.dumps(directory).encode(), 6) + f"{at:{TAIL}d}".encode())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([key]), pa.array([name]), pa.array([n], pa.int64())], ["first_key", "last_key", "file", "n"])

    ship(captures.sparkSession)
    ranged = captures.select("key", "id", "archive", "offset", "length").repartitionByRange(files, "key", "id").sortWithinPartitions("key", "id")
    return cut(ranged.mapInArrow(run, "first_key string, last_key string, file string, n long"), "index-files")


def directory(file) -> list[tuple[str, int, int]]:
    """The sparse directory of an open index file."""
    file.seek(0, 2)
    size = file.tell()
    file.seek(size - TAIL)
    at = int(file.read(TAIL))
    file.seek(at)
    return [tuple(x) for x in json.loads(zlib.decompress(file.read(size - TAIL - at)))]


def block(file, at: int, length: int) -> list[list]:
    file.seek(at)
    return [json.loads(line) for line in zlib.decompress(file.read(length)).decode().split("\n")]


def fetch(file, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    file.seek(offset)
    return parse(zlib.decompress(file.read(length), 31))


def upper_level(index_files: DataFrame) -> list[tuple[str, str, str]]:
    """(first_key, last_key, file) of each index file, in order: as many rows as ``write_index`` was told files."""
    return sorted(tuple(r) for r in index_files.select("first_key", "last_key", "file").toLocalIterator())


def files_with(upper: list[tuple[str, str, str]], firsts: list[str], key: str) -> list[str]:
    """The index files in whose range a key is, by binary search: several if its captures were split."""
    near = upper[max(0, bisect_left(firsts, key) - 1) : bisect_right(firsts, key)]
    return [name for _, last, name in near if last >= key]


class IndexFile:
    """An open index file. Holds its directory and the block that was read last."""

    def __init__(self, file):
        self.file, self.blocks = file, directory(file)
        self.firsts, self._held = [b[0] for b in self.blocks], (-1, [], [])

    def captures(self, key: str) -> Iterator[list]:
        for k in range(max(0, bisect_left(self.firsts, key) - 1), bisect_right(self.firsts, key)):
            if self._held[0] != k:
                lines = block(self.file, *self.blocks[k][1:])
                self._held = k, lines, [x[0] for x in lines]
            _, lines, keys = self._held
            yield from lines[bisect_left(keys, key) : bisect_right(keys, key)]


class CaptureIndex:
    """Searches by URL, one at a time. Holds the upper level only: a row for each index file."""

    def __init__(self, index_files: DataFrame):
        self.files = upper_level(index_files)
        self.firsts = [f[0] for f in self.files]

    def captures(self, url: str | None) -> Iterator[list]:
        """All captures of a URL as [key, id, archive, offset, length]."""
        key = url_key(url)
        for name in files_with(self.files, self.firsts, key):
            with reader(name) as file:
                yield from IndexFile(file).captures(key)

    def records(self, url: str | None) -> Iterator[tuple[dict[str, str], bytes]]:
        for _, _, archive, offset, length in self.captures(url):
            with reader(archive) as file:
                yield fetch(file, offset, length)


def find_captures(urls: DataFrame, index_files: DataFrame, url_col: str = "url", id_type: str = "bigint") -> DataFrame:
    """The captures of all of ``urls``, each once: (key, id, archive, offset, length), a stored table.

    The upper level (a row for each index file) is broadcast. URLs that repeat are
    looked up once by each task; NULL and '' find the captures without URL. URLs
    without captures give no row, an empty table or index an empty one.
    """
    spark = urls.sparkSession
    sent = spark.sparkContext.broadcast(upper_level(index_files))

    def route(batches):
        upper = sent.value
        firsts = [f[0] for f in upper]
        for batch in batches:
            out = sorted({(name, key) for key in {url_key(u) for u in batch.column(0).to_pylist()} for name in files_with(upper, firsts, key)})
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out, strict=True)], ["file", "key"])

    kind = pa.int64() if "int" in id_type else pa.string()

    def search(batches):
        name, file, index, seen = "", None, None, None
        try:
            for batch in batches:
                rows: tuple[list, ...] = ([], [], [], [], [])
                for into, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if into != name:
                        if file is not None:
                            file.close()
                        name, file = into, reader(into)
                        index, seen = IndexFile(file), None
                    if key != seen:
                        seen = key
                        for capture in index.captures(key):
                            for column, value in zip(rows, capture, strict=True):
                                column.append(value)
                            if len(rows[0]) >= 20_000:
                                yield _captures(rows, kind)
                                rows = ([], [], [], [], [])
                if rows[0]:
                    yield _captures(rows, kind)
        finally:
            if file is not None:
                file.close()

    ship(spark)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    routed = urls.select(urls[url_col].cast("string").alias("url")).mapInArrow(route, "file string, key string")
    found = routed.repartition(tasks, "file").sortWithinPartitions("file", "key")
    return cut(found.mapInArrow(search, f"key string, id {'long' if 'int' in id_type else 'string'}, archive string, offset long, length long"), "found-captures")


def _captures(rows: tuple[list, ...], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.string(), kind, pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "id", "archive", "offset", "length"])


#: Bytes of an archive that one task reads records from, about.
SPAN = 128_000_000


def read_records(captures: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Read the record of each capture: (id, url, payload_bytes, payload_digest, kind, refers_to, intact).

    A task takes spans of archives and reads their records by offset, in order.
    ``intact``: a response's payload has the digest and length that its header gives.
    """
    spark = captures.sparkSession

    def number(urn: str | None):
        return None if urn is None or urn == "<urn:page:None>" else int(urn[10:-1]) if "int" in id_type else urn[10:-1]

    kind_type = pa.int64() if "int" in id_type else pa.string()
    types = (kind_type, pa.string(), pa.int64(), pa.string(), pa.string(), kind_type, pa.bool_())
    names = ["id", "url", "payload_bytes", "payload_digest", "kind", "refers_to", "intact"]

    def run(batches):
        source, opened = None, ""
        try:
            for batch in batches:
                rows: tuple[list, ...] = tuple([] for _ in names)
                for archive, offset, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if archive != opened:
                        if source is not None:
                            source.close()
                        source, opened = reader(archive), archive
                    fields, payload = fetch(source, offset, size)
                    kind, sha, n = fields["warc-type"], fields["warc-payload-digest"][5:], int(fields["x-payload-length"])
                    found, long = (digest(payload), len(payload)) if kind == "response" else (sha, n)
                    values = (number(fields["warc-record-id"]), fields["warc-target-uri"], long, found, kind, number(fields.get("warc-refers-to")), (found, long) == (sha, n))
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names)
        finally:
            if source is not None:
                source.close()

    ship(spark)
    id_name = "long" if "int" in id_type else "string"
    places = captures.select("archive", "offset", "length").withColumn("span", F.floor(F.col("offset") / SPAN))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = places.repartition(tasks, "archive", "span").sortWithinPartitions("archive", "offset").drop("span")
    return ordered.mapInArrow(run, f"id {id_name}, url string, payload_bytes long, payload_digest string, kind string, refers_to {id_name}, intact boolean")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write archives and their index; returns the upper level of the index. An empty table gives none."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    return write_index(write_archives(plan_records(pages, id_col, url_col, html_col, least), folder), folder)
