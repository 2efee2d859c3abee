"""Web archives with a two-level capture index.

Pages are written as WARC records, one gzip member each, to files in a shared folder. The
index sorts captures by reversed-host URL key into compressed blocks; a sparse directory
beside each index file has the first key and place of every block, and a short list has
the first key of every index file. A lookup searches the list, then one directory, then
one block by bisection, and reads just that range of the file and of the archive.

Files have names of their own for every attempt of a task; only those that a finished
task reports are ever read, so a repeated task leaves an unused file and nothing else.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areashift.llm.storage import prepared, stored
from areashift.session import scratch_folder

#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: Captures of a block of the index.
BLOCK_LINES = 200
#: Bytes after which a task begins a new archive.
ARCHIVE_BYTES = 1 << 30
#: Pages carry no time of capture.
STAMP = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a path or URI."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:") :]
    return fs.FileSystem.from_uri(folder)


def url_key(url: str | None) -> str:
    """``com,example,www)/path?query``: the host reversed, lower case, without port or user,
    so that the pages of a domain stand together; blanks and controls are escaped."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host = (parts.hostname or "").rstrip(".")
        rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    except ValueError:  # not a URL: kept as it is, under no host
        host, rest = "", url
    return quote(",".join(reversed(host.split("."))) + ")" + rest, safe="!#$%&'()*+,/:;=?@[]~")


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page}')}>"


def header_block(lines: Iterable[tuple[str, object]]) -> bytes:
    return b"".join(f"{k}: {v}".encode() + END for k, v in lines if v is not None)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: a response with its payload, or a revisit with HTTP headers only."""
    http = b"HTTP/1.1 200 OK" + END + header_block(
        [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]
    ) + END
    block = http if revisit else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page)),
        ("WARC-Date", STAMP),
        ("WARC-Target-URI", quote(url or "", safe="!#$%&'()*+,/:;=?@[]~")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(refers_to) if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
        # fields of our own: the numbers of the pages, and the size a revisit leaves out
        ("X-Page-ID", page),
        ("X-Refers-To-Page-ID", refers_to if revisit else None),
        ("X-Payload-Length", len(payload)),
    ]
    return b"WARC/1.1" + END + header_block(head) + END + block + END + END


def read_record(member: bytes) -> dict:
    """Parse one gzip member and check it against its own digest and lengths."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(END + END)
    lines = head.split(END)
    if lines[0] != b"WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.decode().split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != END + END:
        raise ValueError("a record's length is wrong")
    _, _, payload = block.partition(END + END)
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    size = int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response" and (hashlib.sha1(payload).digest() != digest or len(payload) != size):
        raise ValueError("a payload does not match its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page-ID"),
        "payload_bytes": size,
        "payload_digest": digest.hex(),
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-ID"),
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


CAPTURES = "key string, page_id long, file string, offset long, length long"
CAPTURE_NAMES = [c.split()[0] for c in CAPTURES.split(", ")]


def captures_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], CAPTURE_NAMES
    )


def write_archives(
    pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url",
    html_column: str = "html", least: int = REVISIT_BYTES,
) -> DataFrame:
    """Write a record for every row and return the captures: key, page_id, file, offset, length.

    Of rows with equal payloads of at least ``least`` bytes, those with the largest id are
    responses and the others revisit them.
    """
    payload = F.coalesce(F.col(html_column).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_column).cast("long").alias("page"), F.col(url_column).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.concat(F.sha1("payload"), F.lit(":"), F.length("payload")))
    firsts = (
        rows.where(F.length("payload") >= least)
        .groupBy(F.col("digest").alias("__digest"))
        .agg(F.max("page").alias("first"), F.count(F.lit(1)).alias("rows"))
        .where("rows > 1")
        .drop("rows")
    )
    decided = rows.join(firsts, F.col("digest") == F.col("__digest"), "left").select(
        "page", "url", "payload", F.col("first").alias("first"), (F.col("page") < F.col("first")).alias("again")
    )

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = opened(folder)
        out, name, at = None, "", 0
        for batch in batches:
            done = []
            for page, url, payload, first, again in zip(*(c.to_pylist() for c in batch.columns)):
                again = bool(again) or (page is None and first is not None)
                if out is None or at > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"archive-{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                member = gzip.compress(record(page, url, payload, first if again else None, again), 6, mtime=0)
                out.write(member)
                done.append((url_key(url), page, name, at, len(member)))
                at += len(member)
            if done:
                yield captures_batch(done)
        if out is not None:
            out.close()

    return stored(decided.mapInArrow(write, CAPTURES), "captures")


def index_line(key: str, page: int | None, file: str, offset: int, length: int) -> bytes:
    return f"{key} {'' if page is None else page} {json.dumps([file, offset, length])}\n".encode()


def parsed_line(line: bytes) -> tuple[tuple, list]:
    key, page, rest = line.decode().split(" ", 2)
    return place_of(key, int(page) if page else None), json.loads(rest)


def place_of(key: str, page: int | None) -> tuple:
    """Sorts like the index: by the key's bytes, then a missing page first."""
    return key.encode(), page is not None, page or 0


def write_index(captures: DataFrame, folder: str) -> list[tuple]:
    """Write the sorted blocks and directories, and return (first place, file) of every index
    file in order: one per task that wrote any."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = opened(folder)
        name, at, lines, first, start = f"index-{uuid.uuid4().hex}", 0, [], None, None
        blocks, directory, out = 0, None, None

        def flush():
            nonlocal at, blocks, lines
            member = gzip.compress(b"".join(lines), 6, mtime=0)
            out.write(member)
            directory.write(json.dumps([*start, at, len(member)]).encode() + b"\n")
            at, blocks, lines = at + len(member), blocks + 1, []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = files.open_output_stream(f"{path}/{name}.gz", compression=None)
                    directory = files.open_output_stream(f"{path}/{name}.dir", compression=None)
                    first = row[:2]
                if not lines:
                    start = row[:2]
                lines.append(index_line(*row))
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.close()
            directory.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([first[0]]), pa.array([first[1]], pa.int64()), pa.array([name])], ["key", "page_id", "file"]
            )

    ordered = captures.repartitionByRange("key", F.asc_nulls_first("page_id")).sortWithinPartitions(
        "key", F.asc_nulls_first("page_id")
    )
    parts = stored(ordered.mapInArrow(write, "key string, page_id long, file string"), "index")
    # one row per index file, of which there are as many as shuffle partitions
    return sorted((place_of(r["key"], r["page_id"]), r["file"]) for r in parts.collect())


class CaptureIndex:
    """Lookups in the index files of a folder."""

    def __init__(self, folder: str, parts: list[tuple]) -> None:
        self.files, self.path = opened(folder)
        self.parts = parts
        self.firsts = [p for p, _ in parts]
        self.directory = lru_cache(4)(self._directory)
        self.block = lru_cache(8)(self._block)

    def _directory(self, name: str) -> tuple[list, list]:
        with self.files.open_input_file(f"{self.path}/{name}.dir") as file:
            rows = [json.loads(line) for line in file.read().splitlines()]
        return [place_of(*r[:2]) for r in rows], [r[2:] for r in rows]

    def _block(self, name: str, at: int, size: int) -> list[tuple]:
        with self.files.open_input_file(f"{self.path}/{name}.gz") as file:
            data = gzip.decompress(file.read_at(size, at))
        return [parsed_line(line) for line in data.splitlines()]

    def find(self, key: str, page: int | None) -> Iterator[list]:
        """(file, offset, length) of every capture with this key and page."""
        wanted = place_of(key, page)
        # equal captures may begin at the end of the block, or file, before
        part = max(0, bisect_right(self.firsts, wanted) - 1)
        while part > 0 and self.firsts[part] == wanted:
            part -= 1
        for _, name in self.parts[part:]:
            firsts, places = self.directory(name)
            if firsts[0] > wanted:
                return
            block = max(0, bisect_right(firsts, wanted) - 1)
            while block > 0 and firsts[block] == wanted:
                block -= 1
            for first, (at, size) in zip(firsts[block:], places[block:]):
                if first > wanted:
                    return
                lines = self.block(name, at, size)
                low = bisect_right(lines, wanted, key=lambda x: x[0])
                while low > 0 and lines[low - 1][0] == wanted:
                    low -= 1
                for found, where in lines[low:]:
                    if found > wanted:
                        return
                    if found == wanted:
                        yield where


def look_up(wanted: DataFrame, folder: str, parts: list[tuple]) -> DataFrame:
    """(file, offset, length) of the captures of distinct (url, page_id) rows."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(folder, parts)
        for batch in batches:
            rows = [w for url, page in zip(*(c.to_pylist() for c in batch.columns)) for w in index.find(url_key(url), page)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["file", "offset", "length"])

    # neighbours in the index are looked up by one task, which then reads a block once
    host = F.reverse(F.split(F.regexp_extract("url", "^[^/]*//([^/?#]*)", 1), r"\."))
    near = wanted.withColumn("host", F.array_join(host, ",")).repartitionByRange("host", "url", "page_id")
    ordered = near.sortWithinPartitions("host", "url", "page_id").select("url", "page_id")
    return ordered.mapInArrow(find, "file string, offset long, length long").distinct()


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(places: DataFrame, folder: str) -> DataFrame:
    """The records at the given places, each read as a range of its archive."""
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = {"payload_digest": pa.string(), "record_type": pa.string(), "payload": pa.binary()}

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = opened(folder)
        name, file = None, None
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                rows = []
                for archive, offset, length in zip(*(c.to_pylist() for c in batch.slice(low, 200).columns)):
                    if archive != name:
                        if file is not None:
                            file.close()
                        name, file = archive, files.open_input_file(f"{path}/{archive}")
                    rows.append(read_record(file.read_at(length, offset)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[n] for r in rows], kinds.get(n, pa.int64())) for n in names], names
                )
        if file is not None:
            file.close()

    near = places.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return near.select("file", "offset", "length").mapInArrow(read, RECORDS)


def archive_round_trip(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """Write all pages, index them, look every one up and read it back: one row per page row
    with page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for
    revisits).

    A missing html is an empty payload, a missing url the empty key. Rows with the largest
    id of their payload are responses, also where several rows have it; a missing id is
    the smallest. Repeated rows are written and read each. Further columns are not looked
    at, and an empty table gives an empty result.
    """
    spark = prepared(pages.sparkSession)
    folder = scratch_folder(spark, "warc")
    captures = write_archives(pages, folder, id_column, url_column, html_column)
    parts = write_index(captures, folder)
    wanted = pages.select(
        F.col(url_column).cast("string").alias("url"), F.col(id_column).cast("long").alias("page_id")
    ).distinct()
    return read_archives(look_up(wanted, folder, parts), folder)


WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
g AS (SELECT *, octet_length(payload) AS n, max(page_id) OVER (PARTITION BY payload) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
FROM g
"""
