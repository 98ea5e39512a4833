"""BPE encoding and decoding over a distinct-word table.

1. Each block of documents (a run of a scan's partition) is split into words -
   pieces at which byte-level BPE never joins - and numbered. Its distinct
   words go to buckets by hash, packed: a row per (bucket, block).
2. The rows of a bucket meet: each distinct word is encoded once, and its ids go
   back to every block that holds it, in the place where the word was.
3. Ids meet the documents of their block, which are word numbers, and are joined
   to them by position. Decoding joins each id to its piece, in the vocabulary's
   id-to-piece table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import saved, sorted_runs
from seqlab.llm.encoder import default_path, id_to_piece, in_chunks, piece_encoder, split_pieces

WORDS = "bucket int, block long, words binary"
#: kind 0: ids of a bucket's words; 1: the bucket of each word number; 2: documents as word numbers.
PARTS = "block long, kind int, bucket int, payload binary, doc_ids array<long>, lengths array<int>"

#: Bytes of text for which there is a bucket of words, and the most buckets: a block puts out a row for each.
BUCKET_BYTES, MOST_BUCKETS = 1 << 26, 1024

ENCODED = "doc_id long, n_tokens long, ids binary, decoded string, ids_sha256 string, decoded_sha256 string"


def _squeeze(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed; like bytes stand together."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _spread(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _pair(first: bytes, second: bytes) -> bytes:
    return len(first).to_bytes(4, "little") + first + second


def _unpair(data: bytes) -> tuple[bytes, bytes]:
    n = 4 + int.from_bytes(data[:4], "little")
    return data[4:n], data[n:]


class _Block:
    """Words of a block by number, in order of first use."""

    def __init__(self, number: int):
        self.number, self.n = number, count()
        self.spaced: dict[str, int] = {}
        self.whole: dict[str, int] = {}
        self.size = 0

    def numbers(self, text: str) -> np.ndarray:
        head, rest, bare = split_pieces(text)
        whole, take = self.whole, self.n
        out = [whole[head] if head in whole else whole.setdefault(head, next(take))] if head else []
        table = self.spaced if bare else whole
        found = list(map(table.get, rest))
        if None in found:
            for at, x in enumerate(found):
                if x is None:
                    word = rest[at]
                    found[at] = table[word] if word in table else table.setdefault(word, next(take))
        out += found
        self.size += len(out)
        return np.array(out, "<u4")

    def words(self, buckets: int) -> tuple[list[bytes], np.ndarray]:
        """The words by number, and their buckets."""
        words: list[bytes] = [b""] * (len(self.spaced) + len(self.whole))
        for word, at in self.spaced.items():
            words[at] = b" " + word.encode()
        for word, at in self.whole.items():
            words[at] = word.encode()
        return words, np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(buckets)


def _blocks(batches: Iterator[pa.RecordBatch], block_words: int, each) -> Iterator[_Block]:
    """Blocks as they fill; ``each`` gets (doc_id, numbers). Runs the same way whenever a partition is read again."""
    k, block = 0, None
    for batch in batches:
        for rows, texts in in_chunks(batch):
            part = rows.column("part")[0].as_py()
            block = block or _Block(part << 24)
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), texts, strict=True):
                each(doc_id, block.numbers(text))
            if block.size >= block_words:
                yield block
                k += 1
                block = _Block((part << 24) + k)
    if block is not None:
        yield block


def _word_lists(block_words: int, buckets: int):
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, block_words, lambda *_: None):
            words, of = block.words(buckets)
            order = np.argsort(of, kind="stable")
            ends = np.cumsum(np.bincount(of, minlength=buckets)).tolist()
            out = []
            for bucket, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                if b > a:
                    mine = [words[i] for i in order[a:b].tolist()]
                    sizes = np.fromiter(map(len, mine), "<u4", len(mine))
                    out.append((bucket, block.number, _pair(_squeeze(sizes), zstandard.ZstdCompressor(level=3).compress(b"".join(mine)))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "block", "words"])

    return lists


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PARTS.split(", ")])


def _encode_words(path: str, most: int = 2_000_000):
    """Rows sorted by bucket: each distinct word of a bucket is encoded once (again only if a bucket has over ``most``)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known, now = piece_encoder(path), {}, None
        for batch in batches:
            for bucket, block, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "words")), strict=True):
                if bucket != now or len(known) > most:
                    known, now = {}, bucket
                sizes, data = _unpair(packed)
                data, ends = zstandard.ZstdDecompressor().decompress(data), np.cumsum(_spread(sizes)).tolist()
                words = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                new = [w for w in words if w not in known]
                known.update(zip(new, encoder.ids_of_words([w.decode() for w in new]), strict=True))
                ids = [known[w] for w in words]
                counts = np.fromiter(map(len, ids), "<u4", len(ids)) // np.uint32(4)
                yield _parts([(block, 0, bucket, _pair(_squeeze(counts), _squeeze(np.frombuffer(b"".join(ids), "<u4"))), None, None)])

    return encode


def _documents(block_words: int, buckets: int, row_words: int = 1 << 16):
    """The buckets of each block's word numbers, and its documents as numbers, some in a row."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        ids: list = []

        def each(doc_id, numbers):
            held.append(numbers)
            ids.append(doc_id)

        for block in _blocks(batches, block_words, each):
            yield _parts([(block.number, 1, 0, _squeeze(block.words(buckets)[1]), None, None)])
            cuts = np.flatnonzero(np.diff(np.cumsum([len(x) for x in held]) // row_words, prepend=0)).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(held)], strict=True):
                if b > a:
                    yield _parts([(block.number, 2, a, _squeeze(np.concatenate(held[a:b])), ids[a:b], [len(x) for x in held[a:b]])])
            held.clear()
            ids.clear()

    return documents


def _assemble(path: str, with_text: bool):
    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = id_to_piece(path)
        packs: list[bytes] = []
        start = size = flat = None
        for run in sorted_runs(batches, ["block", "kind"]):
            kind, payloads = run.column("kind")[0].as_py(), run.column("payload").to_pylist()
            if kind == 0:
                packs = payloads
                continue
            if kind == 1:
                order = np.argsort(_spread(payloads[0]), kind="stable")
                split = [_unpair(p) for p in packs]
                packs = []
                counts = np.concatenate([_spread(a) for a, _ in split] or [np.empty(0, np.uint32)]).astype(np.int64)
                flat = np.concatenate([_spread(b) for _, b in split] or [np.empty(0, np.uint32)])
                if len(counts) != len(order):
                    raise RuntimeError("a block's words and documents differ: its rows were not read the same way twice; save() them first")
                start, size = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
                start[order], size[order] = np.cumsum(counts) - counts, counts  # by word number
                continue
            for payload, doc_ids, lengths in zip(payloads, run.column("doc_ids").to_pylist(), run.column("lengths").to_pylist(), strict=True):
                numbers, at, out = _spread(payload), 0, []
                for doc_id, n in zip(doc_ids, lengths, strict=True):
                    mine = numbers[at : at + n]
                    at += n
                    sizes = size[mine]
                    ends = np.cumsum(sizes)
                    ids = flat[np.repeat(start[mine] - ends + sizes, sizes) + np.arange(ends[-1] if n else 0)]
                    data = ids.astype("<u4").tobytes()
                    text = b"".join(map(pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")
                    out.append((doc_id, len(ids), data if with_text else None, text if with_text else None, hashlib.sha256(data).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in ENCODED.split(", ")])

    return assemble


def encode_decode(docs: DataFrame, *, tokenizer_path: str | None = None, outputs: bool = True, fixed_scan: bool = False, block_words: int = 1 << 20, buckets: int | None = None) -> DataFrame:
    """Encode every text over the distinct-word table, then decode its ids.

    Returns doc_id, n_tokens, ids (little-endian unsigned 32-bit integers),
    decoded, and the SHA-256 of both (lower-case hex); without ``outputs`` ids
    and decoded are null. Ids equal the library's with add_special_tokens=False.

    ``docs`` is read twice and must give the same rows in the same order in
    each partition both times. A scan of files does (``fixed_scan=True``); any
    other plan is written as a table first. ``block_words``: words from which a
    block is closed; it bounds what a task holds, not what it handles.

    Edge cases: a null or empty text has no tokens and decodes to the empty
    text; special tokens' strings are encoded as their ids, as the library does
    by default; text without spaces is one word. Repeated rows and null doc_ids
    give a row each. An empty table gives none. Other columns are ignored.

    Plan: two shuffles - the packed distinct words of blocks by bucket (one for
    BUCKET_BYTES of text, within bounds, unless ``buckets`` says so; a bucket is
    read as a stream), and by block their ids
    and the documents as compressed word numbers. A common word is in one pack
    of each block.
    """
    path = tokenizer_path or default_path()
    rows = docs.select("doc_id", "text")
    if not fixed_scan:
        rows = saved(rows, "bpe-docs")
    if buckets is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = min(MOST_BUCKETS, max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES))
    rows = rows.withColumn("part", F.spark_partition_id())  # of the scan, wherever its rows go next
    words = rows.mapInArrow(_word_lists(block_words, buckets), WORDS)
    encoded = words.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_encode_words(path), PARTS)
    parts = encoded.unionByName(rows.mapInArrow(_documents(block_words, buckets), PARTS))
    return parts.repartition("block").sortWithinPartitions("block", "kind", "bucket").mapInArrow(_assemble(path, outputs), ENCODED)
