"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles; equal sets are one class of copies,
represented once. Representatives that agree in a band of their MinHash values
are candidates; candidates are compared by more and more MinHash values and
dropped once the posterior probability that their similarity reaches the
threshold falls below a tolerance; the rest is verified on the shingle sets.

Pairs are compared inside tasks, block against block, and never emitted: tasks
put out links per document and a spanning forest of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import ascii_words, broadcast_if_small, saved, sorted_runs

HASHES, BAND = 128, 4

#: Most members of a block, and about how many bytes of their shingles it may have.
MOST_MEMBERS, BLOCK_BYTES = 8192, 1 << 25
SIGNED = "doc_id long, set_key binary, n_shingles int, signature binary"

_random = np.random.default_rng(20240229)
_MULTIPLY = _random.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _random.integers(0, 2**32, HASHES, dtype=np.uint32)
_PLACE = _random.integers(0, 2**63, 64, dtype=np.uint64) | np.uint64(1)


class _WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, hashes: dict[bytes, int], size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of fewer words, all of them are one shingle."""
    words = ascii_words(text)
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(w))
    rolled = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        rolled += w[i : i + len(rolled)] * _PLACE[i]
    return np.unique(_mixed(rolled))


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a set."""
    x, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 2**32 - 1, np.uint32)
    for a in range(0, len(x), 2048):
        least = np.minimum(least, (x[a : a + 2048, None] * _MULTIPLY + _ADD).min(axis=0))
    return least


def _sign(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            keys, sizes, signatures = [], [], []
            for text in batch.column("text"):
                shingles = shingle_set(text.as_py(), hashes, size)
                keys.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                sizes.append(len(shingles))
                signatures.append(signature(shingles).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signatures, pa.binary())], names=["doc_id", "set_key", "n_shingles", "signature"])

    return sign


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(batch.num_rows, HASHES // BAND, BAND).astype(np.uint64)
            bucket = np.broadcast_to(np.arange(1, HASHES // BAND + 1, dtype=np.uint64), values.shape[:2]).copy()
            for i in range(BAND):
                bucket = _mixed(bucket * _PLACE[i] + values[:, :, i])
            ids = np.repeat(batch.column("id").to_numpy(), HASHES // BAND)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64).ravel()), pa.array(ids)], names=["bucket", "id"])


def least_matches(threshold: float, tolerance: float, step: int = 16) -> list[int]:
    """For ``step``, 2 ``step``, ... compared values, the matches below which a pair is dropped.

    With a uniform prior the posterior of the similarity after m matches of n is
    Beta(m + 1, n - m + 1), and it exceeds t with the probability that a
    binomial of n + 1 trials at t is at most m.
    """
    out = []
    for n in range(step, HASHES + 1, step):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def _candidates(sizes: np.ndarray, side: np.ndarray, other: bool, threshold: float, chunk: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a block (or of two) whose sizes allow the threshold, some at a time, so that only members are held."""
    a, b = (np.flatnonzero(~side), np.flatnonzero(side)) if other else (np.arange(len(sizes)),) * 2
    for i in range(0, len(a), chunk):
        for j in range(0 if other else i, len(b), chunk):
            x, y = a[i : i + chunk], b[j : j + chunk]
            first, second = np.repeat(x, len(y)), np.tile(y, len(x))
            if not other and i == j:
                first, second = first[first < second], second[first < second]
            small, large = np.minimum(sizes[first], sizes[second]), np.maximum(sizes[first], sizes[second])
            fit = small >= threshold * large - 1e-9
            yield first[fit], second[fit]


def _prune(signatures: np.ndarray, first: np.ndarray, second: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Compare MinHash values step by step; drop pairs that have too few matches so far."""
    step = HASHES // len(least)
    matches = np.zeros(len(first), np.int32)
    for i, needed in enumerate(least):
        part = signatures[:, i * step : (i + 1) * step]
        for a in range(0, len(first), 1 << 16):
            s = slice(a, a + (1 << 16))
            matches[s] += (part[first[s]] == part[second[s]]).sum(axis=1)
        stay = matches >= needed
        first, second, matches = first[stay], second[stay], matches[stay]
    return first, second


def _roots(n: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, first, before[second])
        np.minimum.at(root, second, before[first])
        root = root[root]
        if (root == before).all():
            return root


def _run_arrays(run: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    i, j = run.column("i")[0].as_py(), run.column("j")[0].as_py()
    ids, sizes = run.column("id").to_numpy(), run.column("n_shingles").to_numpy()
    signatures = np.frombuffer(b"".join(run.column("signature").to_pylist()), np.uint32).reshape(len(ids), HASHES)
    return ids, sizes, signatures, run.column("mine").to_numpy() != i, i != j


def _link_candidates(threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for run in sorted_runs(batches, ["bucket", "i", "j"]):
            ids, sizes, signatures, side, other = _run_arrays(run)
            root = np.arange(len(ids))
            for first, second in _candidates(sizes, side, other, threshold):
                apart = root[first] != root[second]  # what is joined already needs no other edge
                first, second = _prune(signatures, first[apart], second[apart], least)
                if len(first):
                    root = _roots(len(ids), np.concatenate([root, first]), np.concatenate([np.arange(len(ids)), second]))
            moved = np.flatnonzero(root != np.arange(len(ids)))
            if len(moved):
                held.append((ids[root[moved]], ids[moved]))
            if len(held) >= 1000:
                yield _edges(held)
        yield _edges(held)

    return link


def _edges(held: list) -> pa.RecordBatch:
    """Distinct edges, the smaller id first."""
    pairs = np.concatenate([np.column_stack(x) for x in held]) if held else np.empty((0, 2), np.int64)
    held.clear()
    pairs = np.unique(np.sort(pairs, axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _shared(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, width: int = 8192) -> np.ndarray:
    """Exact sizes of the intersections of two lists of sets, by products of presence matrices."""
    flat = np.concatenate([sets[i] for i in (*rows, *columns)])
    owner = np.repeat(np.arange(len(rows) + len(columns)), [len(sets[i]) for i in (*rows, *columns)])
    _, term, seen = np.unique(flat, return_inverse=True, return_counts=True)
    keep = seen[term] > 1
    term, owner = term[keep], owner[keep]
    number = np.cumsum(seen > 1) - 1
    term = number[term]
    out = np.zeros((len(rows), len(columns)), np.int64)
    order = np.argsort(term, kind="stable")
    term, owner = term[order], owner[order]
    for a in range(0, int(term[-1]) + 1 if len(term) else 0, width):
        s = slice(*np.searchsorted(term, [a, a + width]))
        present = np.zeros((len(rows) + len(columns), width), np.float32)
        present[owner[s], term[s] - a] = 1
        out += (present[: len(rows)] @ present[len(rows) :].T).astype(np.int64)
    return out


def _verify(threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in sorted_runs(batches, ["comp", "i", "j"]):
            ids, sizes, signatures, side, other = _run_arrays(run)
            sets = [np.frombuffer(x, np.uint64) for x in run.column("shingles").to_pylist()]
            links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for first, second in _candidates(sizes, side, other, threshold):
                first, second = _prune(signatures, first, second, least)
                if not len(first):
                    continue
                rows, columns = np.unique(first), np.unique(second)
                shared = _shared(sets, rows, columns)[np.searchsorted(rows, first), np.searchsorted(columns, second)]
                linked = shared >= threshold * (sizes[first].astype(np.int64) + sizes[second] - shared) - 1e-9
                first, second = first[linked], second[linked]
                links += np.bincount(first, minlength=len(ids)) + np.bincount(second, minlength=len(ids))
                root = _roots(len(ids), np.concatenate([root, first]), np.concatenate([np.arange(len(ids)), second]))
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(links[some])], names=["id", "root", "links"])

    return verify


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of the ids of edges (a, b): comp is the smallest id of the connected component.

    Each round sends every vertex to its smallest neighbour, follows these to
    their end by pointer jumping, and contracts the edges to what they lead to;
    what is left is at most half the vertices, and no edge is read twice. Each
    step is a written table.
    """
    edges = saved(edges.select("a", "b"), "edges")
    members = edges.select(F.col("a").alias("id")).unionAll(edges.select(F.col("b").alias("id"))).distinct().withColumn("comp", F.col("id"))
    edges = saved(edges.where("a <> b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = saved(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("b")).select("v", F.least("v", "b").alias("low")), "lows")
        while True:
            on = to.select(F.col("v").alias("low"), F.col("low").alias("far"))
            jumped = saved(to.join(on, "low").select("v", "low", "far"), "lows")
            to = jumped.select("v", F.col("far").alias("low"))
            if jumped.where("far < low").isEmpty():
                break
        members = saved(members.join(to.select(F.col("v").alias("comp"), "low"), "comp", "left").select("id", F.coalesce("low", "comp").alias("comp")), "components")
        a, b = to.select(F.col("v").alias("a"), F.col("low").alias("low_a")), to.select(F.col("v").alias("b"), F.col("low").alias("low_b"))
        moved = edges.join(a, "a").join(b, "b").where("low_a <> low_b")
        edges = saved(moved.select(F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b")).distinct(), "edges")
    return members


def members_per_block(n: Column, shingles: Column, block: int) -> Column:
    """Members of a block of a component of ``n`` members with ``shingles`` shingles in all.

    A sixteenth of the component, so that a member goes to sixteen blocks
    however large it is (to more only beyond MOST_MEMBERS or BLOCK_BYTES, which
    bound what a task holds); small components are one block.
    """
    fit = F.floor(n.cast("double") * BLOCK_BYTES / 8 / F.greatest(shingles.cast("double"), F.lit(1.0)))
    return F.greatest(F.lit(1), F.least(F.greatest(F.lit(max(1, block // 4)), F.ceil(n / 16)), F.lit(MOST_MEMBERS), fit))


def _block_pairs(rows: DataFrame, n: str, per: Column) -> DataFrame:
    """Deal the rows of each group to blocks of about ``per`` by a hash, and to every pair of blocks (i, j) that theirs is in."""
    blocks = F.ceil(F.col(n) / per).cast("int")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("yours", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("i", F.least("mine", "yours")).withColumn("j", F.greatest("mine", "yours")).drop("yours", n)


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, size: int = 5, tolerance: float = 1e-6, block: int = 256, max_broadcast_rows: int = 200_000) -> DataFrame:
    """Classes of documents whose shingle sets have a Jaccard similarity of ``threshold`` or more.

    Returns a row per input row: doc_id, rep_id (smallest doc_id with the same
    set), class_id (smallest doc_id of the connected component of links),
    n_copies (rows with the same set) and n_links (other distinct sets linked to
    its own). Similarity is exact; a link may be missed only with the chance
    that no band of 32 agrees (below 5e-8 at 0.8) or of the tolerance.

    Words are lower-cased in A-Z; a text of fewer than ``size`` words is one
    shingle. Edge cases: texts without words have no set; they are in no class
    but their own (rep_id and class_id are their doc_id, n_copies 1, n_links 0),
    as are rows with a null doc_id. Repeated rows are copies of one another. An
    empty table gives no rows. Other columns are ignored.

    Plan: copies are combined before anything is joined. Large buckets and
    components are dealt to blocks (see ``members_per_block``), and each pair of
    blocks is a group of its own, so that a task holds a bounded part of a group
    and rows are not copied to more blocks as it grows. In a bucket, pairs that
    others have joined already are not compared.
    Shingle sets are rebuilt only for members of candidate components.
    """
    rows = docs.select("doc_id", "text")
    signed = saved(rows.mapInArrow(_sign(size), SIGNED), "signatures")
    usable = signed.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    reps = usable.groupBy("set_key").agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("n_copies"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    reps = saved(reps.withColumn("id", F.monotonically_increasing_id()), "representatives")

    bands = reps.select("id", "signature").mapInArrow(_bands, "bucket long, id long")
    # written, so that the join below has an exchange on either side and a hot bucket can be split
    shared = saved(bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = bands.join(shared, "bucket").join(reps.select("id", "n_shingles", "signature"), "id")
    # each pair of blocks puts out a forest of its own, so they are large
    dealt = _block_pairs(members, "n", F.least(F.greatest(F.lit(2 * block), F.ceil(F.col("n") / 16)), F.lit(MOST_MEMBERS)))
    keys = ["bucket", "i", "j"]
    candidates = components(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_link_candidates(threshold, tolerance), "a long, b long"))

    candidates = candidates.join(reps.select("id", "rep_id", "set_key", "n_shingles"), "id")
    sizes = candidates.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"))
    sizes = sizes.select("comp", "n", members_per_block(F.col("n"), F.col("total"), block).cast("long").alias("per"))
    wanted = saved(candidates.join(sizes, "comp").select(F.col("rep_id").alias("doc_id"), "set_key", "id", "comp", "n", "per"), "candidates")
    wanted, _ = broadcast_if_small(wanted, max_broadcast_rows)
    texts = rows.join(wanted, "doc_id").select("text", "set_key", "id", "comp", "n", "per")
    dealt = _block_pairs(texts.mapInArrow(_sets(size), SETS).dropDuplicates(["id"]), "n", F.col("per")).drop("per")
    keys = ["comp", "i", "j"]
    verified = saved(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verify(threshold, tolerance), "id long, root long, links long"), "links")

    classes = components(verified.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b")))
    of_class = classes.join(reps.select("id", "rep_id"), "id")
    least = of_class.groupBy("comp").agg(F.min("rep_id").alias("class_id"))
    links = verified.groupBy("id").agg(F.sum("links").alias("n_links"))
    named = reps.select("id", "set_key", "rep_id", "n_copies").join(of_class.select("id", "comp").join(least, "comp").select("id", "class_id"), "id", "left").join(links, "id", "left")
    named = named.select("set_key", "rep_id", "n_copies", F.coalesce("class_id", "rep_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    of_rows = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    alone = F.col("rep_id").isNull()
    return of_rows.join(named, "set_key", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("rep_id")).alias("rep_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("n_copies")).cast("long").alias("n_copies"), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
    )


SETS = "id long, comp long, n long, per long, n_shingles int, signature binary, shingles binary"


def _sets(size: int):
    """Shingle sets of representatives; a row whose doc_id is theirs but whose text isn't is left out."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                found = [shingle_set(t.as_py(), hashes, size) for t in part.column("text")]
                same = [xxhash.xxh3_128_digest(s.tobytes()) == k for s, k in zip(found, part.column("set_key").to_pylist(), strict=True)]
                columns = [part.column(c) for c in ("id", "comp", "n", "per")] + [pa.array([len(s) for s in found], pa.int32()), pa.array([signature(s).tobytes() for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SETS.split(", ")]).filter(pa.array(same))

    return sets
