"""Token-ID files: independent zstandard frames with a trailing seek table.

File format, all integers little-endian:

* data frames: each an independent zstandard frame of the ids (unsigned 32-bit)
  of consecutive documents; a document never crosses frames;
* a directory, as a skippable frame (magic 0x184D2A5D): zstandard-compressed
  arrays of doc_id (i64), frame (u32), n_tokens (u32) and whether there is a
  doc_id (u8) of the documents;
* the seek table, as the skippable frame (magic 0x184D2A5E) of the public
  zstandard seekable format: for each frame compressed size, decompressed size
  and checksum (lower 32 bits of XXH64 of its content), then the number of
  frames, a descriptor (0x80: with checksums) and the magic 0x8F92EAB1.

A reader takes the last bytes, the seek table and the directory, and then
decompresses only the frames of the documents it wants.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlab.llm.common import qualified, saved, scratch
from seqlab.llm.encoder import default_path, in_chunks, piece_encoder

SKIPPABLE_DIRECTORY, SKIPPABLE_SEEK_TABLE, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<III")

MANIFEST = "file string, first_doc long, last_doc long, n_docs long, n_ids long"

#: Bytes of text for which there is a file, and those that are worth a task of their own while there are fewer tasks than cores.
FILE_BYTES, TASK_BYTES = 1 << 28, 1 << 23

#: About as many documents are asked of a file at once.
ASKED = 10_000
READ = "file string, seq long, doc_id long, start long, n_tokens long, ids_crc32 long"


class TokenFileWriter:
    """Writes one file; ``frame_bytes`` is the size from which a frame is closed."""

    def __init__(self, sink, frame_bytes: int = 1 << 18, level: int = 3):
        self.sink, self.frame_bytes = sink, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.open: list[bytes] = []
        self.held = 0
        self.frames: list[bytes] = []
        self.docs: list[int | None] = []
        self.frame_of: list[int] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.held + len(ids) > self.frame_bytes:
            self._close_frame()
        self.open.append(ids)
        self.held += len(ids)
        self.docs.append(doc_id)
        self.frame_of.append(len(self.frames))
        self.lengths.append(len(ids) // 4)

    def _close_frame(self) -> None:
        content = b"".join(self.open)
        frame = self.compressor.compress(content)
        self.frames.append(ENTRY.pack(len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.sink.write(frame)
        self.open, self.held = [], 0

    def close(self) -> None:
        if self.open:
            self._close_frame()
        known = [x is not None for x in self.docs]
        directory = b"".join(np.array(x, kind).tobytes() for x, kind in (([x or 0 for x in self.docs], "<i8"), (self.frame_of, "<u4"), (self.lengths, "<u4"), (known, "u1")))
        directory = self.compressor.compress(directory)
        self.sink.write(struct.pack("<II", SKIPPABLE_DIRECTORY, len(directory)) + directory)
        table = b"".join(self.frames) + FOOTER.pack(len(self.frames), 0x80, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(table)) + table)


class TokenFileReader:
    """Reads one file by its seek table and directory."""

    def __init__(self, source):
        self.source, self.decompressor = source, zstandard.ZstdDecompressor()
        size = source.seek(0, 2)
        n, descriptor, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE or descriptor != 0x80:
            raise ValueError("not a seekable file with checksums")
        at = size - FOOTER.size - n * ENTRY.size
        self.frames = list(ENTRY.iter_unpack(self._read(at, n * ENTRY.size)))
        self.starts = [0]
        for compressed, _, _ in self.frames:
            self.starts.append(self.starts[-1] + compressed)
        head, length = struct.unpack("<II", self._read(self.starts[-1], 8))
        if head != SKIPPABLE_DIRECTORY:
            raise ValueError("no directory")
        directory = self.decompressor.decompress(self._read(self.starts[-1] + 8, length))
        m = len(directory) // 17
        self.docs = np.frombuffer(directory, "<i8", m)
        self.frame_of = np.frombuffer(directory, "<u4", m, 8 * m)
        self.lengths = np.frombuffer(directory, "<u4", m, 12 * m)
        self.known = np.frombuffer(directory, "u1", m, 16 * m).astype(bool)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        compressed, size, checksum = self.frames[k]
        content = self.decompressor.decompress(self._read(self.starts[k], compressed)) if compressed else b""
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return content

    def rows(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(place in the file, ids) of all documents or of the wanted places, frame by frame."""
        places = np.arange(len(self.docs)) if wanted is None else np.array(sorted(wanted), np.int64)
        ends = 4 * np.cumsum(self.lengths, dtype=np.int64)
        begins = ends - 4 * self.lengths.astype(np.int64)
        first = np.searchsorted(self.frame_of, np.arange(len(self.frames)))
        now, content = -1, b""
        for i in places.tolist():
            k = int(self.frame_of[i])
            if k != now:
                now, content = k, self.frame(k)
            base = begins[first[k]]
            yield i, content[begins[i] - base : ends[i] - base]


def _writer(folder: str, path: str, end_id: int | None, frame_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = pafs.FileSystem.from_uri(folder)
        encoder, end = piece_encoder(path), b"" if end_id is None else struct.pack("<I", end_id)
        name, sink, writer = f"{uuid.uuid4().hex}.ids.zst", None, None
        for batch in batches:
            for part, texts in in_chunks(batch):
                if writer is None:
                    filesystem.create_dir(base, recursive=True)
                    sink = filesystem.open_output_stream(f"{base}/{name}", compression=None)
                    writer = TokenFileWriter(sink, frame_bytes)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                    writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            sink.close()
            row = (f"{folder}/{name}", writer.docs[0], writer.docs[-1], len(writer.docs), sum(writer.lengths))
            kinds = (pa.string(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    return write


def files_for(docs: DataFrame) -> int:
    """A file for FILE_BYTES of text; more, down to TASK_BYTES each, while that keeps idle cores busy."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // FILE_BYTES), min(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))


def write_token_files(docs: DataFrame, folder: str, *, tokenizer_path: str | None = None, end_id: int | None = 2, frame_bytes: int = 1 << 18) -> DataFrame:
    """Encode whole texts, write them in ascending doc_id order, return the manifest.

    The manifest (file, first_doc, last_doc, n_docs, n_ids) is a written table;
    a file that it does not name is the rest of a task that was lost and counts
    for nothing. Files follow each other by first_doc and last_doc; their order
    is that of ids.

    Edge cases: a null text is empty and holds the end id alone; rows with a
    null doc_id come first; they and rows that repeat a doc_id follow each other in an order that is not defined, in one file or in
    two neighbours. An empty table gives an empty manifest.

    Plan: one range shuffle of the texts on doc_id; each task encodes and
    writes its range as a file of its own. The number of files follows the bytes
    of text (``files_for``), whatever the number of shuffle partitions is.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    parts = files_for(docs)
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    manifest = ordered.mapInArrow(_writer(folder, tokenizer_path or default_path(), end_id, frame_bytes), MANIFEST)
    return saved(manifest, "token-manifest")


def _open(file: str):
    filesystem, path = pafs.FileSystem.from_uri(file)
    return filesystem.open_input_file(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
            with _open(file) as source:
                reader = TokenFileReader(source)
                crc = np.fromiter((zlib.crc32(ids) for _, ids in reader.rows()), np.int64, len(reader.docs))
                n = reader.lengths.astype(np.int64)
                start = base + np.cumsum(n) - n
                for a in range(0, len(n), 10_000):
                    s = slice(a, a + 10_000)
                    yield pa.RecordBatch.from_pydict({"file": pa.array([file] * len(n[s])), "seq": np.arange(len(n))[s], "doc_id": pa.array(reader.docs[s], mask=~reader.known[s]), "start": start[s], "n_tokens": n[s], "ids_crc32": crc[s]})


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: file, seq, doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it, in all files. Every
    frame's checksum is verified. The manifest has one row per file, so that the
    running sum over it is as small as the number of tasks that wrote.
    """
    order = Window.orderBy("first_doc", "last_doc", "file")
    bases = manifest.withColumn("base", F.sum("n_ids").over(order) - F.col("n_ids"))
    return bases.select("file", "base").repartition(max(1, manifest.count()), "file").mapInArrow(_reader, READ)


def fetch_tokens(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ids (array<long>) of wanted doc_ids; only their frames are decompressed.

    ``wanted``: doc_id; null asks for nothing. Each file is asked for the ids in
    its range, which are found by bisection of the files' ranges (a row per task
    that wrote goes through the driver), in groups of about ``ASKED``.
    """
    files = manifest.where("last_doc is not null").select(F.coalesce("first_doc", F.lit(-(2**63))).alias("low"), F.col("last_doc").alias("high"), "file").collect()
    files = sorted((f["low"], f["high"], f["file"]) for f in files)
    lows, highs = [f[0] for f in files], [f[1] for f in files]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(files[k][2], i) for i in batch.column("doc_id").to_pylist() for k in range(bisect_left(highs, i), bisect_right(lows, i))]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())], names=["file", "doc_id"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, ids in zip(batch.column("file").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                with _open(file) as source:
                    reader = TokenFileReader(source)
                    places = np.flatnonzero(np.isin(reader.docs, ids) & reader.known).tolist()
                    for i, x in reader.rows(places):
                        yield pa.RecordBatch.from_arrays([pa.array([reader.docs[i]], pa.int64()), pa.array([np.frombuffer(x, "<u4").astype(np.int64)], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    asked = saved(wanted.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().mapInArrow(find, "file string, doc_id long"), "asked-docs")
    groups = max(1, -(-asked.count() // (ASKED * max(1, len(files)))))
    dealt = asked.groupBy("file", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("g")).agg(F.collect_list("doc_id").alias("ids"))
    return dealt.select("file", "ids").mapInArrow(fetch, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, *, tokenizer_path: str | None = None, end_id: int | None = 2) -> DataFrame:
    """Write files in the shared folder and read them back."""
    folder = scratch(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, tokenizer_path=tokenizer_path, end_id=end_id))
