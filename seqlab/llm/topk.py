"""Exact top-k by exhaustive term-at-a-time accumulation.

Vectors become sparse rows of integer weights. Candidates are packed into
blocks, each an inverted index: for each term the postings (candidate, weight).
Query rows, in blocks too, scatter their weighted postings term by term into a
dense score array of the block pair; a partition selection keeps the k best of
each query, and the kept ones of all blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlab.llm.common import saved, scratch

PACKED = "block int, ids binary, owner binary, term binary, weight binary"
FOUND = "query_id long, vec_id long, score long"


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null for a vector that is null or holds null or non-finite components."""
    value = F.transform(vector, lambda x: x.cast("double"))
    # NaN is above every number here, and a null compares as null
    fine = F.forall(value, lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False)))
    return F.when(fine, F.transform(value, lambda x: F.floor(x * scale)))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block of a batch: the ids, and (row in block, term, weight) of all weights that aren't 0, by term."""
    for batch in batches:
        blocks = batch.column("block").to_numpy(zero_copy_only=False)
        for b in np.unique(blocks):
            part = batch.filter(pa.array(blocks == b)).sort_by("vec_id")
            vectors = part.column("weights")
            weight = vectors.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(vectors.offsets.to_numpy())
            owner = np.repeat(np.arange(part.num_rows), sizes)
            term = np.arange(len(weight)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            order = np.lexsort((owner, term))
            order = order[weight[order] != 0]
            arrays = [part.column("vec_id").to_numpy(), owner[order], term[order], weight[order]]
            kinds = ("<i8", "<i4", "<i4", "<i8")
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([a.astype(k).tobytes()], pa.binary()) for a, k in zip(arrays, kinds, strict=True))], names=["block", "ids", "owner", "term", "weight"])


def _unpacked(batch: pa.RecordBatch, i: int, prefix: str) -> list[np.ndarray]:
    return [np.frombuffer(batch.column(prefix + c)[i].as_py(), k) for c, k in (("ids", "<i8"), ("owner", "<i4"), ("term", "<i4"), ("weight", "<i8"))]


def _accumulate(k: int, cells: int = 1 << 20):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q_owner, q_term, q_weight = _unpacked(batch, i, "q_")
                ids, owner, term, weight = _unpacked(batch, i, "c_")
                queries, found, scores = [], [], []
                step = max(1, cells // max(1, len(ids)))
                postings = {t: slice(a, b) for t, a, b in zip(*_ranges(term), strict=True)}
                rows = {t: slice(a, b) for t, a, b in zip(*_ranges(q_term), strict=True)}
                for lo in range(0, len(q_ids), step):
                    part = np.arange(lo, min(lo + step, len(q_ids)))
                    dense = np.zeros((len(part), len(ids)), np.int64)
                    for t, where in rows.items():
                        if t in postings:
                            mine = slice(*(where.start + np.searchsorted(q_owner[where], [lo, lo + len(part)])))
                            to, of = owner[postings[t]], weight[postings[t]]
                            scattered = q_weight[mine][:, None] * of[None, :]
                            if len(to) == len(ids) and len(scattered) == len(part):  # every cell gets a share
                                dense += scattered
                            else:
                                dense[np.ix_(q_owner[mine] - lo, to)] += scattered
                    own = np.searchsorted(ids, q_ids[part])
                    valid = np.ones(dense.shape, bool)
                    for r, (q, at) in enumerate(zip(q_ids[part], own, strict=True)):
                        while at < len(ids) and ids[at] == q:
                            valid[r, at] = False
                            at += 1
                    dense[~valid] = np.iinfo(np.int64).min
                    for r, q in enumerate(q_ids[part]):
                        n = min(k, int(valid[r].sum()))
                        if n:
                            least = np.partition(dense[r], len(ids) - n)[len(ids) - n]
                            above = np.flatnonzero((dense[r] > least) & valid[r])
                            equal = np.flatnonzero((dense[r] == least) & valid[r])[: n - len(above)]  # ids ascend: ties to the smaller
                            kept = np.concatenate([above, equal])
                            queries.append(np.full(len(kept), q))
                            found.append(ids[kept])
                            scores.append(dense[r, kept])
                if queries:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (queries, found, scores)], names=["query_id", "vec_id", "score"])

    return search


def _ranges(sorted_values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    values, first = np.unique(sorted_values, return_index=True)
    return values.tolist(), first.tolist(), [*first[1:].tolist(), len(sorted_values)]


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, block_rows: int = 2048, query_rows: int = 1024, query_blocks: int = 16) -> DataFrame:
    """The k candidates of highest integer inner product for each query row.

    ``vectors``, ``queries``: vec_id (long), weights (array<long>); the place in
    the array is the term, and zeros are no postings. Arrays may differ in
    length. A row is no candidate for a query of the same vec_id. Returns
    query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.

    Edge cases: null vec_ids and null weights take no part (nor arrays that hold
    nulls). Repeated candidates are candidates each; a repeated query_id is
    answered once, from the first of its weights in order. Fewer candidates
    than k give all of them; without candidates a query has no rows.

    Plan: every query meets every candidate, in blocks. ``query_blocks`` packed
    blocks of ``query_rows`` queries are broadcast at once (a bound in rows);
    more queries take more passes over the candidates, which are packed once, in
    blocks of about ``block_rows``. Each pass appends what it found to one table
    (k rows per query and block at most), so that the plan does not grow with
    the queries. A task holds one block pair, and emits k rows per query at
    most. No group grows with the data, whatever vectors are common.
    """
    usable = F.col("vec_id").isNotNull() & F.col("weights").isNotNull() & ~F.exists("weights", lambda x: x.isNull())
    vectors = vectors.select("vec_id", "weights").where(usable)
    queries = queries.select("vec_id", "weights").where(usable).groupBy("vec_id").agg(F.min("weights").alias("weights"))

    def packed_blocks(rows: DataFrame, size: int, tag: str) -> tuple[DataFrame, int]:
        rows = saved(rows, tag)
        n = max(1, -(-rows.count() // size))
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).repartition(n, "block").sortWithinPartitions("block")
        return dealt.mapInArrow(_pack, PACKED), n

    parts = ("ids", "owner", "term", "weight")
    candidates, _ = packed_blocks(vectors, block_rows, "topk-candidates")
    candidates = saved(candidates, "topk-packed-candidates")
    asked, n_asked = packed_blocks(queries, query_rows, "topk-queries")
    asked = saved(asked.select(F.col("block").alias("q_block"), *(F.col(c).alias(f"q_{c}") for c in parts)), "topk-packed-queries")
    path = scratch(vectors.sparkSession, "topk-found")
    for first in range(0, n_asked, query_blocks):
        last = min(first + query_blocks, n_asked) - 1
        dealt = candidates.select(*(F.col(c).alias(f"c_{c}") for c in parts), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("q_block"))
        pairs = dealt.join(F.broadcast(asked.where(F.col("q_block").between(first, last))), "q_block")
        part = pairs.select(*(f"{s}_{c}" for s in "qc" for c in parts)).mapInArrow(_accumulate(k), FOUND)
        part.write.mode("append").parquet(path)
    found = vectors.sparkSession.read.schema(FOUND).parquet(path)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
