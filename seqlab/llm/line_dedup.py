"""Line dedup: drop lines that many documents share, keep one holder of each.

Method: explode normalised lines, hash them (128 bit), count the documents per
hash with map-side combining, join the hashes over the threshold back to the
lines, and reassemble each document by line position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import saved, unused

#: Stripped at both ends of a line before it is compared.
BLANK = b" \t\n\x0b\x0c\r"

LINES = "doc_id long, row_key long, line_hash binary, positions array<int>"
KEPT = "doc_id long, row_key long, text string, n_lines long, n_dropped long, kept_sha256 string"


def _line_rows(min_chars: int):
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, hashes, positions = [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "row_key", "text"))
            for doc_id, row_key, text in zip(*columns, strict=True):
                found: dict[bytes, list[int]] = {}
                for at, line in enumerate(text.encode().lower().split(b"\n")):
                    key = line.strip(BLANK)
                    if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                        found.setdefault(key, []).append(at)
                ids += [doc_id] * len(found)
                rows += [row_key] * len(found)
                hashes += [xxhash.xxh3_128_digest(k) for k in found]
                positions += found.values()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(hashes, pa.binary()), pa.array(positions, pa.list_(pa.int32()))],
                names=["doc_id", "row_key", "line_hash", "positions"],
            )

    return lines


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, total, dropped, digests = [], [], [], []
        for text, drops in zip(batch.column("text").to_pylist(), batch.column("drops").to_pylist(), strict=True):
            lines = text.split("\n")
            gone = set(drops or ())
            kept = "\n".join([x for at, x in enumerate(lines) if at not in gone]) if gone else text
            texts.append(kept)
            total.append(len(lines))
            dropped.append(len(gone))
            digests.append(hashlib.sha256(kept.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_key"), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string())],
            names=["doc_id", "row_key", "text", "n_lines", "n_dropped", "kept_sha256"],
        )


def with_kept_lines(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with the lines that stay as their text, and all other columns.

    As ``dedup_lines`` (see there); a null text stays null.
    """
    columns = docs.columns
    key, gone = unused("row_key", columns), unused("drops", columns)
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    drops = _drops(keyed.select("doc_id", "text", F.col(key).alias("row_key")), min_chars, min_docs).withColumnRenamed("drops", gone)
    drop_id, drop_key = drops.columns[0], drops.columns[1]
    met = keyed.join(drops, keyed["doc_id"].eqNullSafe(drops[drop_id]) & (keyed[key] == drops[drop_key]), "left").select(*(keyed[c] for c in columns), drops[gone])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dropped = [set(d or ()) for d in batch.column(gone).to_pylist()]
            texts = [t if t is None or not d else "\n".join([x for at, x in enumerate(t.split("\n")) if at not in d]) for t, d in zip(batch.column("text").to_pylist(), dropped, strict=True)]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(texts, pa.string())).select(columns)

    return met.mapInArrow(kept, docs.schema)


def _drops(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """For each (drop_id, drop_key) the positions of lines to drop. ``rows``: doc_id, text, row_key."""
    lines = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "row_key").mapInArrow(_line_rows(min_chars), LINES)
    held = lines.select("line_hash", "doc_id").distinct()  # a document counts once, however often its row is repeated
    common = held.groupBy("line_hash").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
    common = common.where(F.col("n_docs") >= min_docs)
    common = saved(common, "common-lines")  # so that the join has an exchange on either side and a hot line can be split
    return (
        lines.join(common.select("line_hash", "keeper"), "line_hash")
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "row_key")
        .agg(F.flatten(F.collect_list("positions")).alias("drops"))
        .select(F.col("doc_id").alias("drop_id"), F.col("row_key").alias("drop_key"), "drops")
    )


def dedup_lines(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Drop shared lines from every document; one row per input row.

    A line's key is the line without white space at its ends, A-Z lower-cased.
    Keys of at least ``min_chars`` code points that ``min_docs`` documents or
    more hold lose all their lines, save those of the largest ``doc_id`` that
    holds it. Returns doc_id, row_key, text (what stays, joined by newlines),
    n_lines (before), n_dropped and kept_sha256; other columns are not carried.

    Edge cases: a null or empty text is one empty line and stays so (text is
    then empty). Documents are distinct doc_ids, so rows that repeat one count
    once; null is none, and below every other. Rows that share the largest
    doc_id all keep the line. An empty table gives no rows.

    Plan: one shuffle of distinct (hash, doc_id), and one of (hash, partial
    count, largest id); one of the lines'
    hashes joined to the hashes to drop (a hot line is split by adaptive skew
    handling, and its count is combined before the shuffle); one of the texts
    joined to their dropped positions. No group is collected, but the dropped
    positions of one document.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row_key", F.xxhash64("text"))
    drops = _drops(rows, min_chars, min_docs)
    met = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.col("row_key") == F.col("drop_key")), "left")
    return met.select("doc_id", "row_key", "text", "drops").mapInArrow(_reassemble, KEPT)
