"""Euclidean silhouettes of many clusterings from one pass of distances.

The exact silhouette needs the distance of every two points. Points are packed
into blocks once; a task keeps one block, and others come to it one after
another. Distances of two blocks are one matrix product, centred on the task's
block, and what that leaves inexact is computed again from the differences.
They are added up by the clusters of all clusterings, so that trying many
numbers of clusters costs sums, not distances; where sums are short, two blocks
meet once and both have their sums from it, made for points that are in the same
clusters of all clusterings together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.sources.scratch import saved

#: Points of a block at most, and at least where there are fewer than PARTS blocks; bytes of a block's vectors, and of the sums that a task keeps for it.
BLOCK, SMALL, PARTS = 16384, 2048, 48
BLOCK_BYTES, SUM_BYTES = 1 << 25, 1 << 26
#: Clusters of all clusterings up to which sums are short whatever the vectors' length.
SHORT = 32
#: Blocks that come to a task where two blocks meet once.
COMPANY = 32
#: Squared distances below this share of the squared lengths are computed again; squared lengths from FAR on count as infinite.
CLOSE, FAR = 2.0**-16, 1e300
#: Rows and columns of distances at a time; where sums are short, so many that they stay in a core's cache.
ROWS, COLUMNS = 256, 1024
TILE = 192, 384
PACKED = "block int, keys array<string>, x binary, places binary, labels binary"
SUMMED = "block int, task int, keys array<string>, places binary, labels binary, sums binary, sizes binary"
SAMPLES = "key string, silhouettes array<double>"


def _short(dims: int, tops: Sequence[int]) -> bool:
    """Whether a point's sums are about as short as its vector, so that they may be sent as well."""
    return sum(tops) + len(tops) <= max(dims, SHORT)


def _pack(dims: int):
    """One row for each block: its different vectors, and the keys, places among the vectors, and labels of its points."""

    def row(block: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(parts).combine_chunks()
        x, labels = (part.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(t) for c, t in (("x", "<f8"), ("labels", "<i4")))
        _, first, places = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, 8 * dims))), return_index=True, return_inverse=True)
        values = [pa.array([block], pa.int32()), pa.array([part.column("key").to_pylist()], pa.list_(pa.string()))]
        values += [pa.array([v.tobytes()], pa.binary()) for v in (x.reshape(-1, dims)[first], places.astype("<i4"), labels)]
        return pa.RecordBatch.from_arrays(values, names=["block", "keys", "x", "places", "labels"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []
        for batch in batches:  # sorted by block
            blocks = batch.column("block").to_numpy(zero_copy_only=False)
            for b in np.unique(blocks):
                if parts and b != block:
                    yield row(block, parts)
                    parts = []
                block = b
                parts.append(batch.filter(pa.array(blocks == b)).select(["key", "x", "labels"]))
        if parts:
            yield row(block, parts)

    return pack


def _numbered(row: dict, tops: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["places"], "<i4"), np.frombuffer(row["labels"], "<i4").reshape(-1, len(tops))


class _Points:
    """A block: its vectors, squared lengths apart, and how many of its points are where and in which clusters."""

    def __init__(self, row: dict, dims: int, tops: Sequence[int]):
        x = np.frombuffer(row["x"], "<f8").reshape(-1, dims)
        with np.errstate(over="ignore", invalid="ignore"):
            self.far = ~(np.einsum("ij,ij->i", x, x) < FAR)
        self.x = np.where(self.far[:, None], 0.0, x) if self.far.any() else x
        self.places, self.labels = _numbered(row, tops)
        self.at = self.labels + np.cumsum([0, *(t + 1 for t in tops)])[:-1]
        self.clusters = sum(tops) + len(tops)
        lost = self.far[self.places]
        #: Points of each cluster, and those of them that are infinitely far away.
        self.sizes = np.stack([np.bincount(at.ravel(), minlength=self.clusters) for at in (self.at, self.at[lost])])
        self.near = np.flatnonzero(~lost)

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """(how many points of a vector are in each class, the clusters of each class); points in the same clusters are a class, or those of a cluster where that makes fewer."""
        found, of = np.unique(self.at[self.near], axis=0, return_inverse=True)
        if len(found) < self.clusters:
            members, of = np.zeros((len(found), self.clusters)), of.reshape(-1, 1)
            np.put_along_axis(members, found, 1.0, axis=1)
        else:
            members, of = np.eye(self.clusters), self.at[self.near]
        w = np.zeros((len(self.x), len(members)))
        np.add.at(w, (self.places[self.near, None], of), 1.0)
        return w, members

    def runs(self) -> list[list[tuple]]:
        """For each COLUMNS points and clustering: the points' vectors in order of cluster, the clusters, and where each begins."""
        out = []
        for a in range(0, len(self.near), COLUMNS):
            at = self.at[self.near[a : a + COLUMNS]]
            orders = np.argsort(at, axis=0, kind="stable").T
            out.append([(order, *np.unique(at[order, k], return_index=True)) for k, order in enumerate(orders)])
        return out


def _distances(a: np.ndarray, b: np.ndarray, high: int, wide: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, distances) by ``high`` rows and ``wide`` columns; the array is used again."""
    centre = a.mean(axis=0)
    p, q = a - centre, b - centre
    pp, qq = np.einsum("ij,ij->i", p, p), np.einsum("ij,ij->i", q, q)
    left, right = np.column_stack([-2 * p, pp, np.ones(len(p))]), np.column_stack([q, np.ones(len(q)), qq])
    room = np.empty(min(high, len(a)) * min(wide, len(b)))
    for j in range(0, len(b), wide):
        r, rr = right[j : j + wide].T, qq[j : j + wide]
        for i in range(0, len(a), high):
            ll = pp[i : i + high]
            d = np.matmul(left[i : i + high], r, out=room[: len(ll) * len(rr)].reshape(len(ll), len(rr)))
            if d.min() < CLOSE * (ll.max() + rr.max()):
                rows, columns = np.nonzero(d < CLOSE * (ll[:, None] + rr))
                for c in range(0, len(rows), 4096):
                    u, v = rows[c : c + 4096], columns[c : c + 4096]
                    gap = a[i + u] - b[j + v]
                    d[u, v] = np.einsum("ij,ij->i", gap, gap)
            yield i, j, np.sqrt(d, out=d)


class _Sums:
    """The distances of a block's points, added up by the clusters of each clustering."""

    def __init__(self, own: _Points, short: bool):
        self.own, self.totals, self.sizes = own, np.zeros((len(own.x), own.clusters)), np.zeros_like(own.sizes)
        self.totals[own.far] = np.inf
        self.weights = None
        if short:
            weights, self.members = own.weights()
            self.weights = np.ascontiguousarray(weights.T)

    def add(self, other: _Points) -> np.ndarray | None:
        """Adds the distances from the other block; where sums are short, returns those of the other's points."""
        self.sizes += other.sizes
        if self.weights is None:
            for j, runs in enumerate(other.runs()):
                vectors = other.places[other.near[j * COLUMNS : (j + 1) * COLUMNS]]
                for i, _, d in _distances(self.own.x, other.x[vectors], ROWS, COLUMNS):
                    for order, found, starts in runs:
                        self.totals[i : i + len(d), found] += np.add.reduceat(d[:, order], starts, axis=1)
            return None
        weights, members = other.weights()
        sums, back = np.zeros((len(self.own.x), len(members))), np.zeros((len(self.members), len(other.x)))
        for i, j, d in _distances(self.own.x, other.x, *TILE):
            sums[i : i + d.shape[0]] += d @ weights[j : j + d.shape[1]]
            if other is not self.own:
                back[:, j : j + d.shape[1]] += self.weights[:, i : i + d.shape[0]] @ d
        self.totals += sums @ members
        return back.T @ self.members


def _samples(row: dict, totals: np.ndarray, sizes: np.ndarray, tops: Sequence[int]) -> pa.RecordBatch:
    """The silhouettes of a block's points; 0 in a cluster of one, where there is no other cluster, or far away."""
    places, labels = _numbered(row, tops)
    out = np.zeros(labels.shape)
    totals[:, sizes[1] > 0] = np.inf
    first = 0
    for k, top in enumerate(tops):
        size, total = sizes[0, first : first + top + 1], totals[:, first : first + top + 1]
        first += top + 1
        for a in range(0, len(out), SMALL):
            own = labels[a : a + SMALL, k]
            at, sums = np.arange(len(own)), total[places[a : a + SMALL]]
            with np.errstate(divide="ignore", invalid="ignore"):
                mean = sums / size
                x = sums[at, own] / (size[own] - 1)
                mean[:, size == 0] = np.inf
                mean[at, own] = np.inf
                y = mean.min(axis=1)
                s = (y - x) / np.maximum(x, y)
            out[a : a + SMALL, k] = np.where((size[own] > 1) & np.isfinite(y) & np.isfinite(s), s, 0.0)
    values = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, len(tops)), pa.int32()), pa.array(out.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(row["keys"], pa.string()), values], names=["key", "silhouettes"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _go_through(dims: int, tops: Sequence[int]):
    """Of rows sorted by task, its own block first: the samples, or, where sums are short, the sums that each meeting gives both blocks."""
    short = _short(dims, tops)

    def summed(row: dict, own: dict, sums: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        values = [pa.array([v]) for v in (row["block"], own["task"])] + [pa.array([row[c] if row is own else None], t) for c, t in (("keys", pa.list_(pa.string())), ("places", pa.binary()), ("labels", pa.binary()))]
        values = [v.cast(pa.int32()) for v in values[:2]] + values[2:] + [pa.array([v.tobytes()], pa.binary()) for v in (sums, sizes)]
        return pa.RecordBatch.from_arrays(values, names=["block", "task", "keys", "places", "labels", "sums", "sizes"])

    def done(own: dict, sums: _Sums) -> pa.RecordBatch:
        return summed(own, own, sums.totals, sums.sizes) if short else _samples(own, sums.totals, sums.sizes, tops)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sums = None
        for row in _rows(batches):
            if row["task"] != (own and own["task"]):
                if own:
                    yield done(own, sums)
                own = sums = None
            if row["step"] == 0:
                own, points = row, _Points(row, dims, tops)
                sums = _Sums(points, short)
                if row["keys"] is not None:  # in the first of the block's tasks its points meet each other
                    sums.add(points)
            elif own:  # a block may be empty
                back = sums.add(_Points(row, dims, tops))
                if short:
                    yield summed(row, own, back, sums.own.sizes)
        if own:
            yield done(own, sums)

    return go


def _finish(tops: Sequence[int]):
    """The samples from all sums of a block, in rows sorted by it."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = own = None
        for row in _rows(batches):
            if row["block"] != block:
                if own:
                    yield _samples(own, totals, sizes, tops)
                block, own, totals, sizes = row["block"], None, 0.0, 0
            own = row if row["keys"] is not None else own
            totals = totals + np.frombuffer(row["sums"], "<f8").reshape(-1, sum(tops) + len(tops))
            sizes = sizes + np.frombuffer(row["sizes"], "<i8").reshape(2, -1)
        if own:
            yield _samples(own, totals, sizes, tops)

    return finish


def silhouette_samples(points: DataFrame, clusterings: Sequence[str], *, key: str = "id", features: str = "features", block: int = BLOCK) -> DataFrame:
    """(key as string, silhouettes): the silhouette of each point in each of the clusterings (columns of cluster numbers from 0).

    A cluster of one has 0, as has a clustering of one cluster. Points without
    features or with a null cluster are left out. A point with a component that
    is no finite number is infinitely far from all others, and has 0.

    Plan: one shuffle deals the points to blocks of at most about ``block`` (fewer
    where vectors are long or clusters many, so that a task's block and sums stay
    within BLOCK_BYTES and SUM_BYTES). Where sums are short, a block is sent to the
    half of the blocks before it in a circle, COMPANY to a task, and one more
    shuffle brings the sums of a block together; else it is sent to every other's
    task. Work is that of all pairs, and copies of a block grow with their number.
    """
    usable = F.col(features).isNotNull() & ~F.greatest(*(F.col(c).isNull() for c in clusterings), F.lit(False))
    rows = points.where(usable).select(F.col(key).cast("string").alias("key"), F.col(features).cast("array<double>").alias("x"), F.array(*(F.col(c).cast("int") for c in clusterings)).alias("labels"))
    rows = saved(rows, "silhouette-points")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dims"), F.array(*(F.max(F.get("labels", F.lit(i))) for i in range(len(clusterings)))).alias("tops")).first()
    if not stats["n"]:
        return points.sparkSession.createDataFrame([], SAMPLES)
    dims, tops = stats["dims"], stats["tops"]
    most = min(block, max(SMALL, -(-stats["n"] // PARTS)), BLOCK_BYTES // (8 * max(1, dims)), SUM_BYTES // (8 * (sum(tops) + len(tops))))
    n = -(-stats["n"] // max(1, most))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")).repartitionById(n, "block").sortWithinPartitions("block")
    packed = saved(dealt.mapInArrow(_pack(dims), PACKED), "silhouette-blocks")
    short, b = _short(dims, tops), F.col("block")
    tasks = -(-(n // 2 + 1) // COMPANY) if short else 1
    steps = F.filter(F.sequence(F.lit(0), F.lit(n // 2 if short else n - 1)), lambda s: (s > 0) & ((2 * s < n) | (b >= s) | F.lit(not short)))
    meets = F.transform(steps, lambda s: F.struct((F.pmod(b - s, F.lit(n)) * tasks + s % tasks).alias("task"), s.alias("step")))
    own = F.transform(F.sequence(F.lit(0), F.lit(tasks - 1)), lambda t: F.struct((b * tasks + t).alias("task"), F.lit(0).alias("step")))
    met = packed.withColumn("m", F.explode(F.concat(own, meets))).select("m.*", "block", "x", "places", "labels", F.when((F.col("m.step") == 0) & (F.col("m.task") == b * tasks), F.col("keys")).alias("keys"))
    met = met.repartitionById(n * tasks, "task").sortWithinPartitions("task", "step")
    out = met.mapInArrow(_go_through(dims, tops), SUMMED if short else SAMPLES)
    return out.repartitionById(n, "block").sortWithinPartitions("block", "task").mapInArrow(_finish(tops), SAMPLES) if short else out


def silhouette_curve(points: DataFrame, clusterings: dict[int, str], *, key: str = "id", features: str = "features", block: int = BLOCK) -> DataFrame:
    """(k, silhouette, best): the mean silhouette of each clustering, by its number k; best is the first by (silhouette desc, k)."""
    numbers = list(clusterings)
    samples = silhouette_samples(points, list(clusterings.values()), key=key, features=features, block=block)
    mean = samples.select(F.posexplode("silhouettes").alias("at", "s")).groupBy("at").agg(F.avg("s").alias("silhouette"))
    out = mean.select(F.get(F.array(*map(F.lit, numbers)), F.col("at")).alias("k"), "silhouette")
    first = out.agg(F.min(F.struct((-F.col("silhouette")).alias("s"), "k")).alias("f")).select(F.col("f.k").alias("_k"))
    return out.join(F.broadcast(first)).select("k", "silhouette", (F.col("k") == F.col("_k")).alias("best"))
