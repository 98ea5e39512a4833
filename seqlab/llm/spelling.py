"""Spelling variants by rolling-hash deletions.

Two words are near if one inserted, deleted or replaced code point turns one
into the other. With prefix sums ``W_i`` of ``c_j * B**j`` (modulo 2**64) the
hash of a word without its code point i is ``W_i + (W_L - W_{i+1}) / B``: a
prefix and a suffix, so NumPy makes the integer keys of all deletions of many
words at once. Keys are dealt by their top bits and sorted; words that meet in
a key are looked up and compared as strings, so a collision links nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import saved, sorted_runs

#: Letters of words: ASCII and Latin-1 from A-grave on.
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
#: Code points of words that are hashed at once; a longer word is hashed alone.
_CELLS = 1 << 19

#: The place of a word's own row; replaced places are 0, 1, ..., deleted ones -2, -3, ...
OWN = -1
KEYS = "radix int, key long, place int, id long"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def deletion_keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words of one length L, given as rows of code points: of each word (n), and without each of its places (n x L)."""
    length = codes.shape[1]
    powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(0, length - 1), _BASE, np.uint64))])
    before = np.zeros((len(codes), length + 1), np.uint64)
    np.cumsum(codes.astype(np.uint64) * powers[:length], axis=1, out=before[:, 1:])
    return before[:, -1], before[:, :-1] + (before[:, -1:] - before[:, 1:]) * _INVERSE


def _rows(words: list[str], ids: np.ndarray) -> pa.RecordBatch:
    """The key rows of words of one length."""
    length = len(words[0])
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), length)
    whole, without = deletion_keys(codes)
    place = np.broadcast_to(np.arange(length), without.shape)
    # one place of a run of equal code points stands for the run: the others leave the same string
    first = np.ones(without.shape, bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    keys = np.concatenate([_mixed(whole), _mixed(without[first]), _mixed(without + _mixed(place.astype(np.uint64) + np.uint64(1))).ravel()])
    places = np.concatenate([np.full(len(words), OWN), -2 - place[first], place.ravel()])
    owners = np.concatenate([ids, np.repeat(ids, first.sum(axis=1)), np.repeat(ids, length)])
    arrays = [pa.array((keys >> np.uint64(48)).astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(places.astype(np.int32)), pa.array(owners)]
    return pa.RecordBatch.from_arrays(arrays, names=["radix", "key", "place", "id"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_length = defaultdict(list)
        words, ids = batch.column("word").to_pylist(), batch.column("id").to_numpy()
        for i, w in enumerate(words):
            by_length[len(w)].append(i)
        for length, at in by_length.items():
            step = max(1, _CELLS // max(1, length))
            for a in range(0, len(at), step):
                part = at[a : a + step]
                yield _rows([words[i] for i in part], ids[part])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by key, of keys in which words may be near: two replaced places, or a word and a deleted place."""

    def told(table: pa.RecordBatch) -> pa.RecordBatch:
        key, place = table.column("key").to_numpy(), table.column("place").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        n = [np.add.reduceat(x.astype(np.int32), starts) for x in (place >= 0, place == OWN, place < OWN)]
        keep = (n[0] > 1) | ((n[1] > 0) & (n[2] > 0))
        return table.select(["key", "place", "id"]).filter(pa.array(np.repeat(keep, sizes)))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
        if held and (cut or held[-1].column("key")[-1].as_py() != key[-1]):
            yield told(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0])
            held = []
        elif cut:
            yield told(batch.slice(0, cut))
        held.append(batch.slice(cut))
    if held:
        yield told(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


NEAR = "id long, n_near long, form_n long, form string"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each word of a key has near it there: how many, and the best (largest n, then smallest in code-point order)."""
    out: list[tuple] = []

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["id", "n_near", "form_n", "form"])

    for run in sorted_runs(batches, ["key"]):
        replaced, deleted, own = defaultdict(list), defaultdict(list), {}
        for place, i, n, word in zip(*(run.column(c).to_pylist() for c in ("place", "id", "n", "word")), strict=True):
            if place >= 0:
                replaced[place, word[:place] + word[place + 1 :]].append((-n, word, i))
            elif place == OWN:
                own[word] = (-n, word, i)
            else:
                at = -2 - place
                deleted[word[:at] + word[at + 1 :]].append((-n, word, i))
        for group in replaced.values():
            if len(group) > 1:
                first, second = sorted(group)[:2]
                for x in group:
                    best = second if x == first else first
                    out.append((x[2], len(group) - 1, -best[0], best[1]))
        for text, group in deleted.items():
            if text in own:
                short, best = own[text], min(group)
                out.append((short[2], len(group), -best[0], best[1]))
                out.extend((x[2], 1, -short[0], short[1]) for x in group)
        if len(out) > 20_000:
            yield batch_of()
    yield batch_of()


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_counts(docs: DataFrame, *, min_length: int = 7, min_count: int = 2, thinned: int = 31) -> DataFrame:
    """(word, n): words of whole texts, A-Z lower-cased, of at least ``min_length`` code points and ``min_count`` occurrences.

    A word is a maximal run of LETTERS. Where ``thinned`` divides h, the
    unsigned crc32 of ``<doc_id>:<word>``, the word loses its code point
    h % length before it is counted (0: never), which plants misspellings.
    Runs that are too short are not even taken; counts combine before the
    shuffle, so a frequent word is one row a task.
    """
    runs = F.regexp_extract_all(lowered(F.col("text")), F.lit(f"({LETTERS}{{{max(1, min_length)},}})"), F.lit(1))
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_d"), F.explode(runs).alias("word"))
    if thinned:
        words = words.withColumn("_h", F.crc32(F.concat("_d", F.lit(":"), "word").cast("binary")))
        at = F.pmod(F.col("_h"), F.length("word")).cast("int")
        short = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = words.select(F.when(F.col("_h") % thinned == 0, short).otherwise(F.col("word")).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, form, form_n) of those of ``words`` (id, word, n; all distinct) that have near ones: how many, and the best of them.

    Plan: a word of length L has at most 2 L + 1 keys, integers without the
    word, so that long words cost their length and not its square. Keys are
    dealt by their top 16 bits and sorted. Only keys in which words meet get
    their strings, by a join on the id, and are compared. Words that share a
    key and a place differ there alone: a key has at most as many as there are
    letters, and its words are counted as a group, not as pairs.
    """
    keys = words.select("id", "word").mapInArrow(_keys, KEYS)
    met = saved(keys.repartition("radix").sortWithinPartitions("key").mapInArrow(_met, "key long, place int, id long"), "spelling-keys")
    spelled = met.join(words.select("id", "word", "n"), "id")
    found = spelled.repartition("key").sortWithinPartitions("key").mapInArrow(_verify, NEAR)
    best = F.min(F.struct((-F.col("form_n")).alias("low"), F.col("form").alias("form"))).alias("best")
    out = found.groupBy("id").agg(F.sum("n_near").alias("n_near"), best)
    return out.select("id", "n_near", F.col("best.form").alias("form"), (-F.col("best.low")).alias("form_n"))


def spelling_variants(counts: DataFrame, *, ratio: int = 10) -> DataFrame:
    """Groups of spelling variants among words with counts (word, n; a word once).

    Returns per word: word, form, root, n, n_near, form_n. n_near counts the
    words at exactly one inserted, deleted or replaced code point; form is the
    one of largest n (ties: smallest in code-point order) if that n is at least
    ``ratio`` (> 1) times the word's, else null; root follows forms to the end.

    Edge cases: null words are left out, null counts are 0. The empty word is
    near to words of one code point. Words of any length are compared whole. An
    empty table gives no rows; other columns are ignored.

    Plan: ``near_words``, then pointer jumping over the words that have a form:
    counts grow by ``ratio`` along a chain, so it ends within the logarithm of
    the largest count, and the rounds within the logarithm of that.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1, or chains of forms have no end")
    words = counts.where(F.col("word").isNotNull()).select("word", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    words = saved(words.withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    good = F.col("form_n") >= ratio * F.col("n")
    told = words.join(near_words(words), "id", "left").select(
        "word", F.when(good, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("form_n")).alias("form_n")
    )
    told = saved(told, "spelling-near")
    roots = saved(told.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        jumped = saved(roots.join(on, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "spelling-roots")
        roots = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            break
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(docs: DataFrame, *, min_length: int = 7, min_count: int = 2, thinned: int = 31, ratio: int = 10) -> DataFrame:
    """``spelling_variants`` of the ``word_counts`` of documents (doc_id, text).

    Edge cases: a null text has no words; a null doc_id counts as empty text in
    h; repeated rows count each. Very long texts and words are taken whole.
    """
    return spelling_variants(word_counts(docs, min_length=min_length, min_count=min_count, thinned=thinned), ratio=ratio)
