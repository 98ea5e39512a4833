"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Items are cut into windows of 13 words (a shorter item is one window). A window
is found in a document only if all its words are, so that one of them - the
rarest over all documents - is its necessary prefix. Document words are joined
to prefixes; positional and length bounds place the whole window, and the words
there are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import SEPARATOR_REGEX, broadcast_if_small, saved

WINDOW = 13

#: No word: it marks the end of a document among its words.
END = "\x00"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    """Words in their own case; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATOR_REGEX), "")


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows of all items: window (words joined by spaces), n, item_ids (as strings)."""
    words = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), _words(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)).alias("w"))
    last = F.greatest(F.size("w") - size, F.lit(0))
    starts = words.where(F.size("w") > 0).select("item", "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    words = F.slice("w", F.col("at") + 1, F.lit(size))
    windows = starts.select("item", F.array_join(words, " ").alias("window"), F.size(words).alias("n"))
    return windows.groupBy("window", "n").agg(F.collect_set("item").alias("item_ids"))


def _prefixes(docs: DataFrame, windows: DataFrame, max_rows: int) -> DataFrame:
    """Windows with their rarest word (over all documents) and its place in them."""
    vocabulary, small = broadcast_if_small(saved(windows.select(F.explode(F.split("window", " ")).alias("word")).select(F.lower("word").alias("key")).distinct(), "item-words"), max_rows)
    seen = docs.select(F.explode(_words(F.col("text"))).alias("word")).select(F.lower("word").alias("key"))
    if small:  # the counts have a row per item word at most
        counts = F.broadcast(seen.join(vocabulary, "key").groupBy("key").agg(F.count(F.lit(1)).alias("seen")))
    else:  # counted in part where the texts are, before words meet the vocabulary
        counts = seen.groupBy("key").agg(F.count(F.lit(1)).alias("seen")).join(vocabulary, "key")
    placed = windows.select("window", "n", "item_ids", F.posexplode(F.split("window", " ")).alias("offset", "word")).withColumn("key", F.lower("word"))
    placed = placed.join(counts, "key", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    best = F.min_by(F.struct("key", "offset"), F.struct("seen", "key", "offset")).alias("best")
    return placed.groupBy("window").agg(best, F.first("n").alias("n"), F.first("item_ids").alias("item_ids")).select("window", "n", "item_ids", "best.*")


def decontaminate(docs: DataFrame, items: DataFrame, *, size: int = WINDOW, percent: int = 5, max_broadcast_rows: int = 200_000) -> DataFrame:
    """Words of each document inside an occurrence of a window of an item.

    Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. A
    window is ``size`` consecutive words of an item, or all of a shorter one.
    Returns doc_id, n_words, n_hit (distinct words inside occurrences), n_items,
    item_ids (strings, sorted), items_sha256 and contaminated (some hit, and at
    least ``percent`` of the words).

    Edge cases: null or empty texts have no words and no hits; items without
    words or with a null item_id have no windows. A document is a distinct
    (doc_id, text): repeated rows give one row, a null doc_id is kept. Items
    that repeat windows of others share them. Empty tables give empty or
    hit-free results. Other columns are ignored.

    Plan: two passes over the texts. Item words (first pass) and prefixes
    (second) are broadcast if they have at most ``max_broadcast_rows`` rows and
    256 MB; then nothing but hits and one row per document is shuffled. Beyond
    that, words are counted in part before they are shuffled, places of words are
    joined by a shuffle and windows compared after a join back to the documents.
    Hits meet per document, as distinct windows and places.
    """
    docs = docs.select("doc_id", "text").withColumn("row_key", F.xxhash64("text"))
    windows = saved(item_windows(items, size), "item-windows")
    found = _prefixes(docs, windows, max_broadcast_rows).select("window", "n", "item_ids", "key", "offset")
    ends = docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("window"), F.lit(0).alias("n"), F.lit(None).cast("array<string>").alias("item_ids"), F.lit(END).alias("key"), F.lit(0).alias("offset"))
    prefixes, small = broadcast_if_small(saved(found, "prefixes"), max_broadcast_rows)

    split = docs.select("doc_id", "row_key", _words(F.col("text")).alias("w"))
    at = F.posexplode(F.array_append("w", F.lit(END))).alias("at", "word")
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.col("n") <= F.size("w"))
    # built-in functions with generated code only: then the words' array is a variable of the loop over words, and not copied for each
    same = F.translate(F.array_join(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("n")), " "), _UPPER, _LOWER) == F.col("window")
    is_end, span = F.col("window").isNull(), F.struct(start.alias("a"), (start + F.col("n")).alias("b"))
    if small:
        hits = split.select("doc_id", "row_key", "w", at).withColumn("key", F.lower("word")).join(F.broadcast(prefixes.unionByName(ends)), "key")
        hits = hits.where(is_end | F.when(fits, same))
        hits = hits.select("doc_id", "row_key", F.when(is_end, F.col("at")).alias("words"), F.when(~is_end, span).alias("span"), "item_ids")
    else:
        placed = split.select("doc_id", "row_key", F.posexplode("w").alias("at", "word")).withColumn("key", F.lower("word")).join(prefixes, "key").where(start >= 0)
        whole = split.select(F.col("doc_id").alias("id"), F.col("row_key").alias("rk"), "w").dropDuplicates(["id", "rk"])
        hits = placed.join(whole, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("rk") == F.col("row_key"))).where(F.when(fits, same))
        hits = hits.select("doc_id", "row_key", F.lit(None).cast("int").alias("words"), span.alias("span"), "item_ids")
        # the numbers of words need no join: no key has a row for every document
        hits = hits.unionByName(split.select("doc_id", "row_key", F.size("w").alias("words")), allowMissingColumns=True)

    gathered = hits.groupBy("doc_id", "row_key").agg(F.max("words").cast("long").alias("n_words"), F.collect_set("span").alias("spans"), F.collect_set("item_ids").alias("sets"))
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit"))
    covered = F.aggregate(
        F.array_sort("spans"), none, lambda acc, x: F.struct(F.greatest(acc["end"], x["b"]).alias("end"), (acc["hit"] + F.greatest(F.lit(0), x["b"] - F.greatest(acc["end"], x["a"]))).alias("hit")), lambda acc: acc["hit"]
    )
    out = gathered.select("doc_id", "n_words", covered.cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("sets"))).alias("item_ids"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"), "item_ids",
    )
