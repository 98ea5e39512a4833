"""Token counts by offset-mapped attribution.

Each document is encoded once, as a whole. The byte span of every token (from
its id: byte-level pieces cover the text without gaps) is interval-joined to
the document's sections by binary search, and a token that crosses a section
boundary is allocated by an explicit rule:

* ``first``: to the sections that hold its first byte,
* ``last``: to the sections that hold its last byte,
* ``most``: to the sections that hold its middle byte (of two sections, the one
  with more of it; the earlier one of equals),
* ``share``: to each section by its share of the token's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.encoder import default_path, in_chunks, piece_encoder, piece_sizes

RULES = ("first", "last", "most", "share")
COUNTS = "doc_id long, section long, start long, stop long, n_tokens double, n_crossing long, doc_tokens long"


def attribute(sizes: np.ndarray, start: np.ndarray, stop: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, tokens of it that cross one of its bounds).

    ``sizes``: bytes of the tokens in order; ``start``, ``stop``: byte bounds of
    the sections, which may overlap, leave gaps, or be empty.
    """
    ends = np.cumsum(sizes)
    begins = ends - sizes
    lo, hi = np.minimum(start, stop), stop
    inside = lambda x: np.searchsorted(begins, x, "left") - np.searchsorted(ends, x, "right")  # noqa: E731  1 if a token lies across x
    crossing = inside(lo) + inside(hi)
    both = (np.searchsorted(ends, lo, "right") == np.searchsorted(begins, hi, "left") - 1) & (inside(lo) > 0) & (inside(hi) > 0)
    crossing = np.where(lo < hi, crossing - both, 0)
    if rule == "share":
        at = np.concatenate([[0], ends])
        count = np.interp(hi, at, np.arange(len(at))) - np.interp(lo, at, np.arange(len(at)))
    else:
        anchors = {"first": begins, "last": ends - 1, "most": (begins + ends - 1) // 2}[rule]
        count = np.searchsorted(anchors, hi, "left") - np.searchsorted(anchors, lo, "left")
    return np.where(lo < hi, count, 0).astype(float), crossing.astype(np.int64)


def _to_bytes(text: str, data: bytes, points: np.ndarray) -> np.ndarray:
    """Byte offsets of code point offsets, which are held to the text."""
    points = np.clip(points, 0, len(text))
    if len(data) == len(text):
        return points
    starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return np.append(starts, len(data))[points]


def _counter(path: str, rule: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, piece = piece_encoder(path), piece_sizes(path)
        for batch in batches:
            for part, texts in in_chunks(batch):
                out: list[list[np.ndarray]] = [[] for _ in range(6)]
                reps, ids = [], part.column("doc_id")
                for text, encoded, sections in zip(texts, encoder.encode(texts), part.column("sections"), strict=True):
                    bounds = sections.as_py() if sections.is_valid else None
                    if bounds is None:  # the lines of the text
                        cuts = [0]
                        while (at := text.find("\n", cuts[-1])) >= 0:
                            cuts.append(at + 1)
                        start, stop = np.array(cuts), np.array([*cuts[1:], len(text)])
                    else:
                        start, stop = (np.array([x[k] for x in bounds], np.int64) for k in ("start", "stop"))
                    sizes = piece[np.frombuffer(encoded, "<u4")]
                    data = text.encode()
                    n, crossing = attribute(sizes, _to_bytes(text, data, start), _to_bytes(text, data, stop), rule)
                    reps.append(len(start))
                    for column, values in zip(out, (np.arange(len(start)), start, stop, n, crossing, np.full(len(start), len(sizes))), strict=True):
                        column.append(values)
                take = pa.array(np.repeat(np.arange(len(reps)), reps))
                columns = [pa.array(np.concatenate(c), kind) for c, kind in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.take(take), *columns], names=[c.split()[0] for c in COUNTS.split(", ")])

    return count


def section_tokens(docs: DataFrame, sections: DataFrame | None = None, *, rule: str = "first", tokenizer_path: str | None = None) -> DataFrame:
    """Tokens of each section of each document.

    ``docs``: doc_id, text. ``sections``: doc_id, start, stop in code points
    (half-open; held to the text; they may overlap or leave gaps); without it
    the sections are the lines, each with its newline, so that every token
    belongs to some section. Returns doc_id, section (its place by start, stop),
    start, stop, n_tokens (by ``rule``; whole numbers but for ``share``),
    n_crossing (tokens across one of its bounds) and doc_tokens.

    Edge cases: a null or empty text is one empty line with no tokens. Special
    tokens' strings in a text are encoded as the library does by default. A
    section that is empty, reversed or beyond the text has 0 tokens; one with a
    null bound is left out. With ``sections``, documents without any give no
    row. Repeated rows of ``docs`` are counted each. Other columns are ignored.

    Plan: no shuffle without ``sections``; with it one, on doc_id. A document's
    sections are gathered in one row, as its text is.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rows = docs.select("doc_id", "text")
    kind = "array<struct<start:bigint,stop:bigint>>"
    if sections is None:
        rows = rows.withColumn("sections", F.lit(None).cast(kind))
    else:
        span = F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))
        by_doc = sections.where(F.col("start").isNotNull() & F.col("stop").isNotNull()).groupBy("doc_id").agg(F.array_sort(F.collect_list(span)).alias("sections"))
        rows = rows.join(by_doc, "doc_id").select("doc_id", "text", "sections")
    return rows.mapInArrow(_counter(tokenizer_path or default_path(), rule), COUNTS)
