"""WARC archives with a two-level capture index.

Archives: one gzip member per record, WARC/1.1. Of records with equal payloads
of some size one is a response and the others are revisits, which carry the
HTTP headers (so the payload's length) but no payload.

Index: one line per capture, keyed by the URL with its host reversed, sorted;
lines are cut into compressed blocks, and a sparse directory keeps the first
key of each block with the block's place. A lookup searches the directory by
bisection, reads one block by its range, bisects it, and reads the record by
its range.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import qualified, saved, scratch

CAPTURES = "url_key string, page_id long, archive string, offset long, length long, record_type string, payload_digest string, payload_bytes long"
DIRECTORY = "first_key string, last_key string, index_file string, offset long, length long, n_captures int"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

#: Compressed bytes that a task reads back, and that are read by the same task.
TASK_BYTES, RANGE_BYTES = 1 << 26, 1 << 20

#: Payloads below this are always stored.
LEAST_BYTES = 1000
ID, DATE = "urn:x-capture:", "1970-01-01T00:00:00Z"

#: A record without a page_id is named by its place.
UNNAMED = "at-"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """The URL with its host reversed: http://www.Example.com/a?b -> com,example,www)/a?b."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").lower()
    except ValueError:  # not a URL: kept as it is
        return url or ""
    port = parts.netloc.rpartition("@")[2].rpartition(":")[2]
    port = f":{port}" if port.isdigit() and port not in ("80", "443") else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _warc_url(url: str | None) -> str:
    return quote(url or "", safe="".join(chr(c) for c in range(0x21, 0x7F)))


def _record(record_id: str, url: str, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{ID}{record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        *([] if refers_to is None else [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one record, decompressed."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    kind, name = fields["WARC-Type"], lambda x: x.strip("<>").removeprefix(ID)
    number = lambda x: None if name(x).startswith(UNNAMED) else int(name(x))
    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": n, "payload_digest": digest.hex(), "record_type": kind, "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def _archive_writer(folder: str, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _folder(folder)
        sink, at, name = None, 0, f"{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            rows = []
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if sink is None:
                    filesystem.create_dir(base, recursive=True)
                    sink = filesystem.open_output_stream(f"{base}/{name}", compression=None)
                payload = html.encode()
                digest = hashlib.sha1(payload).digest()
                record = gzip.compress(_record(f"{UNNAMED}{name}-{at}" if page_id is None else str(page_id), _warc_url(url), payload, digest, refers_to), level, mtime=0)
                sink.write(record)
                rows.append((url_key(url), page_id, f"{folder}/{name}", at, len(record), "response" if refers_to is None else "revisit", digest.hex(), len(payload)))
                at += len(record)
            if rows:
                yield _captures(rows)
        if sink is not None:
            sink.close()

    return write


def _captures(rows: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in CAPTURES.split(", ")])


def _payload() -> Column:
    return F.coalesce("html", F.lit(""))


def write_archives(pages: DataFrame, folder: str, *, least_bytes: int = LEAST_BYTES, level: int = 4) -> DataFrame:
    """Write one record per page; the captures, as a written table.

    Of pages with equal payloads of at least ``least_bytes`` bytes (by SHA-1 and
    length), the largest page_id is stored and the others revisit it; a page
    that repeats that page_id is stored too. A null html is empty, a null url
    is the empty URL. A null page_id is below every other: such a page revisits
    the largest, and is stored where no page has one; its record is named by its
    place, and is read back with a null page_id.

    Plan: digests are grouped with map-side combining, so that a payload that
    many pages share is one row per task; digests of two pages or more are
    joined back to narrow rows (digest, page_id), and what each page refers to
    is joined to the pages on page_id.
    """
    folder = qualified(pages.sparkSession, folder)
    pages = pages.select("page_id", "url", _payload().alias("html"))
    narrow = pages.where(F.octet_length("html") >= least_bytes).select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("n"))
    ids = narrow.groupBy("digest", "n").agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("least"), F.count_if(F.col("page_id").isNull()).alias("unnamed"))
    shared = ids.where((F.col("keeper") > F.col("least")) | (F.col("keeper").isNotNull() & (F.col("unnamed") > 0))).select("digest", "n", "keeper")
    shared = saved(shared, "shared-payloads")  # so that the join has an exchange on either side and a hot payload can be split
    refers = narrow.join(shared, ["digest", "n"]).where(~F.col("page_id").eqNullSafe(F.col("keeper"))).select(F.col("page_id").alias("from_id"), F.col("digest").alias("from_digest"), F.col("keeper").alias("refers_to")).distinct()
    met = pages.join(refers, F.col("page_id").eqNullSafe(F.col("from_id")) & (F.sha1("html") == F.col("from_digest")), "left").select("page_id", "url", "html", "refers_to")
    return saved(met.mapInArrow(_archive_writer(folder, level), CAPTURES), "captures")


def _index_writer(folder: str, block_lines: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _folder(folder)
        sink, at, name, held, rows = None, 0, f"{uuid.uuid4().hex}.cdx.gz", [], []

        def block():
            nonlocal sink, at
            if sink is None:
                filesystem.create_dir(base, recursive=True)
                sink = filesystem.open_output_stream(f"{base}/{name}", compression=None)
            data = gzip.compress("".join(json.dumps(x) + "\n" for x in held).encode(), 6, mtime=0)
            sink.write(data)
            rows.append((held[0][0], held[-1][0], f"{folder}/{name}", at, len(data), len(held)))
            at += len(data)
            held.clear()

        for batch in batches:
            for line in zip(*(batch.column(c).to_pylist() for c in ("url_key", "page_id", "archive", "offset", "length", "record_type", "payload_digest", "payload_bytes")), strict=True):
                held.append(line)
                if len(held) >= block_lines:
                    block()
        if held:
            block()
        if sink is not None:
            sink.close()
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in DIRECTORY.split(", ")])

    return write


#: Captures for which there is an index file.
INDEX_CAPTURES = 100_000


def write_index(captures: DataFrame, folder: str, *, block_lines: int = 1000) -> DataFrame:
    """Sort captures by URL key into compressed blocks; the sparse directory, as a written table.

    The directory has a row per block: first_key, last_key, index_file, offset,
    length, n_captures. Captures are range-partitioned by (url_key, page_id), so
    that a host or a URL with very many captures is split; there is an index
    file for INDEX_CAPTURES of them, whatever the number of shuffle partitions is.
    """
    folder = qualified(captures.sparkSession, folder)
    parts = max(1, -(-captures.count() // INDEX_CAPTURES))
    ordered = captures.repartitionByRange(parts, "url_key", "page_id").sortWithinPartitions("url_key", "page_id")
    return saved(ordered.mapInArrow(_index_writer(folder, block_lines), DIRECTORY), "capture-directory")


def _open(file: str):
    filesystem, path = _folder(file)
    return filesystem.open_input_file(path)


def _block_lines(source, offset: int, length: int) -> list[list]:
    source.seek(offset)
    return [json.loads(x) for x in gzip.decompress(source.read(length)).splitlines()]


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The captures of index blocks."""
    for batch in batches:
        for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("index_file", "offset", "length")), strict=True):
            with _open(file) as source:
                lines = _block_lines(source, offset, length)
            yield _captures(lines)


def _read_records(with_payload: bool, gap: int = 1 << 16, most: int = 1 << 23):
    """Records of (archive, offset, length) rows sorted by them; ranges that are near are read at once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        now, source, start, data = None, None, 0, b""

        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True))
            rows, held = [], 0
            for i, (archive, offset, length) in enumerate(places):
                if archive != now:
                    if source is not None:
                        source.close()
                    now, source, data = archive, _open(archive), b""
                if not (start <= offset and offset + length <= start + len(data)):
                    end = offset + length
                    for a, o, n in places[i + 1 :]:
                        if a != archive or o > end + gap or o + n > offset + most:
                            break
                        end = max(end, o + n)
                    source.seek(offset)
                    start, data = offset, source.read(end - offset)
                record = parse_record(zlib.decompress(data[offset - start : offset - start + length], wbits=31))
                rows.append(record if with_payload else record | {"payload": None})
                held += record["payload_bytes"]
                if held > most or i == len(places) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)], names=names)
                    rows, held = [], 0
        if source is not None:
            source.close()

    return read


def read_captures(captures: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """The records of captures (archive, offset, length), read by range in the archives' order and verified.

    The captures are written first, so that the bytes of their records say how
    many tasks read them: rows of captures are small, and so they would be few.
    """
    places = saved(captures.select("archive", "offset", "length"), "asked-captures")
    held = places.agg(F.sum("length")).first()[0] or 0
    n = max(1, -(-held // TASK_BYTES), min(places.sparkSession.sparkContext.defaultParallelism, held // RANGE_BYTES))
    near = places.repartition(n, "archive", F.floor(F.col("offset") / RANGE_BYTES)).sortWithinPartitions("archive", "offset")
    return near.mapInArrow(_read_records(with_payload), RECORDS)


def read_all(directory: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """All records, through the index: its blocks give the ranges to read."""
    blocks = directory.select("index_file", "offset", "length").repartition("index_file", "offset")
    return read_captures(blocks.mapInArrow(_read_blocks, CAPTURES), with_payload=with_payload)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one index file, its directory (blocks by first_key) and the keys asked of it."""
    for batch in batches:
        for file, blocks, keys in zip(*(batch.column(c).to_pylist() for c in ("index_file", "blocks", "keys")), strict=True):
            firsts, lasts = [b["first_key"] for b in blocks], [b["last_key"] for b in blocks]
            found, read = [], {}
            with _open(file) as source:
                for key in sorted(keys):
                    for k in range(bisect_left(lasts, key), bisect_right(firsts, key)):
                        if k not in read:
                            read = {k: _block_lines(source, blocks[k]["offset"], blocks[k]["length"])}  # keys ascend: earlier blocks aren't asked again
                        lines = read[k]
                        found += lines[bisect_left(lines, key, key=lambda x: x[0]) : bisect_right(lines, key, key=lambda x: x[0])]
            if found:
                yield _captures(found)


def lookup(directory: DataFrame, urls: DataFrame, *, keys_at_once: int = 10_000) -> DataFrame:
    """The captures of URLs (a column ``url``), by binary search of the two levels.

    Index files have key ranges that follow each other. Each asked key finds the
    files that may hold it by bisection of their first and last keys (a row per
    task that wrote the index goes through the driver, and no more); in a file
    it finds its blocks by bisection of the directory, and its captures by
    bisection of the block. Keys are asked of a file in groups of about
    ``keys_at_once``. URLs without a capture give no row; a repeated one is
    asked once; null asks for the empty URL.
    """
    files = directory.groupBy("index_file").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).collect()
    files = sorted((f["low"], f["high"], f["index_file"]) for f in files)
    lows, highs = [f[0] for f in files], [f[1] for f in files]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key in {url_key(u) for u in batch.column("url").to_pylist()}:
                found += [(files[k][2], key) for k in range(bisect_left(highs, key), bisect_right(lows, key))]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], names=["index_file", "key"])

    asked = saved(urls.select("url").mapInArrow(find, "index_file string, key string").distinct(), "asked-keys")
    groups = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-asked.count() // (keys_at_once * max(1, len(files)))))))
    blocks = directory.groupBy("index_file").agg(F.array_sort(F.collect_list(F.struct("first_key", "last_key", "offset", "length"))).alias("blocks"))
    keys = asked.groupBy("index_file", groups.alias("g")).agg(F.collect_list("key").alias("keys"))
    return keys.join(blocks, "index_file").select("index_file", "blocks", "keys").mapInArrow(_search, CAPTURES)


def round_trip(pages: DataFrame, *, least_bytes: int = LEAST_BYTES, with_payload: bool = True) -> DataFrame:
    """Write archives and index in the shared folder, and read every page's record back by looking its URL up."""
    folder = scratch(pages.sparkSession, "warc")
    directory = write_index(write_archives(pages, folder, least_bytes=least_bytes), folder)
    return read_captures(lookup(directory, pages), with_payload=with_payload)
