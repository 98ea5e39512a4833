"""Pruned Lloyd iterations (C7, J9, S6): most points keep their cluster without a distance.

A point carries an upper bound of the distance to its centroid and a lower
bound of that to any other. When centroids move, the bounds move with them, and
by the triangle inequality a point stays where it is while the bounds are apart;
else its own distance is computed, and only if that doesn't tell, all of them.
Centroids come to such points in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.sources.scratch import broadcast_if_small, saved

#: Points and centroids of a block, and bytes of centroids that are broadcast at once.
POINTS, CENTROIDS, BROADCAST_BYTES = 1024, 4096, 1 << 26

#: Digits of squared distances; nearer ones are ties, which go to the smaller cluster.
DIGITS = 9
_TIE = 2 * 10.0**-DIGITS

PACKED = "rows binary, x binary"
NEAREST = "row long, cluster int, upper double, lower double"


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def _pack(size: int):
    """(row, x) as blocks, in the order in which they come."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype("<f8")
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (part.column("row").to_numpy().astype("<i8"), x)], names=["rows", "x"])

    return pack


def _two_nearest(x: np.ndarray, numbers: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each point: the nearest centroid, its squared distance, and that of the second.

    A product of matrices finds the few candidates; their distances are then
    computed one by one, so that ties do not depend on its rounding.
    """
    rough = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None] - 2 * x @ c.T
    slack = 1e-9 * (1 + np.abs((x * x).sum(axis=1)) + (c * c).sum(axis=1).max())
    second = np.partition(rough, min(1, rough.shape[1] - 1), axis=1)[:, min(1, rough.shape[1] - 1)]
    at, of = np.nonzero(rough <= (second + slack)[:, None])
    exact = np.zeros(len(at))
    for a in range(0, len(at), 1 << 16):
        s = slice(a, a + (1 << 16))
        gap = x[at[s]] - c[of[s]]
        exact[s] = (gap * gap).sum(axis=1)
    order = np.lexsort((numbers[of], np.round(exact, DIGITS), at))
    at, of, exact = at[order], of[order], exact[order]
    heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    n = np.diff(np.append(heads, len(at)))
    far = np.where(n > 1, exact[np.minimum(heads + 1, len(at) - 1)], np.inf)
    return numbers[of[heads]], exact[heads], far


def _scan(dims: int, blocks: int):
    """Points' blocks with centroids' blocks: the two nearest so far are kept while a points' block goes on, over all ``blocks``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = best = None
        met = 0

        def done() -> pa.RecordBatch:
            if met != blocks:
                raise RuntimeError("a block of points met its centroids in parts: they are not joined by a broadcast")
            rows, (cluster, near, far) = np.frombuffer(last, "<i8"), best
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (rows, cluster.astype(np.int32), near, far)], names=["row", "cluster", "near", "far"])

        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("rows")[i].as_py()
                x, numbers, c = (np.frombuffer(batch.column(k)[i].as_py(), kind) for k, kind in (("x", "<f8"), ("numbers", "<i8"), ("c", "<f8")))
                found = _two_nearest(x.reshape(-1, dims), numbers, c.reshape(-1, dims))
                if rows != last:
                    if last is not None:
                        yield done()
                    last, best, met = rows, found, 1
                    continue
                met += 1
                better = (np.round(found[1], DIGITS) < np.round(best[1], DIGITS)) | ((np.round(found[1], DIGITS) == np.round(best[1], DIGITS)) & (found[0] < best[0]))
                best = (np.where(better, found[0], best[0]), np.where(better, found[1], best[1]), np.where(better, np.minimum(best[1], found[2]), np.minimum(best[2], found[1])))
        if last is not None:
            yield done()

    return scan


def two_nearest(points: DataFrame, centroids: DataFrame, *, dims: int, max_bytes: int = BROADCAST_BYTES, block: int = CENTROIDS) -> DataFrame:
    """(row, cluster, near, far): the nearest centroid of each point (row long, x array<double>), and the squared distances of it and of the second (infinite if there is none).

    Every point meets every centroid, block by block. Centroids (cluster, centroid) are packed into blocks,
    of which as many as ``max_bytes`` hold are broadcast at once; more of them take more passes over the points.
    """
    packed = points.select("row", "x").mapInArrow(_pack(POINTS), PACKED)
    c = centroids.select(F.col("cluster").cast("long").alias("row"), F.col("centroid").cast("array<double>").alias("x"))
    c = c.mapInArrow(_pack(block), PACKED).select(F.col("rows").alias("numbers"), F.col("x").alias("c"))
    c = saved(c.withColumn("at", F.monotonically_increasing_id()), "centroid-blocks")
    sizes = sorted(tuple(r) for r in c.select("at", (F.octet_length("c") + F.octet_length("numbers")).alias("n")).collect())  # a row a block
    passes, used = [[]], 0
    for at, n in sizes:
        if passes[-1] and used + n > max_bytes:
            passes.append([])
            used = 0
        passes[-1].append(at)
        used += n
    found = []
    for some in passes:
        blocks = F.broadcast(c.where(F.col("at").isin(some)))
        dealt = packed.withColumn("at", F.explode(F.array(*(F.lit(a).cast("long") for a in some)))) if some else packed.withColumn("at", F.lit(-1).cast("long"))
        found.append(dealt.join(blocks, "at").select("rows", "x", "numbers", "c").mapInArrow(_scan(dims, len(some)), "row long, cluster int, near double, far double"))
    if len(found) == 1:
        return found[0]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    one = F.struct(F.round("near", DIGITS).alias("o"), "cluster", F.col("near").alias("d"))
    other = F.struct(F.round("far", DIGITS).alias("o"), F.lit(2**31 - 1).alias("cluster"), F.col("far").alias("d"))
    best = every.select("row", F.explode(F.array(one, other)).alias("b")).groupBy("row").agg(F.sort_array(F.collect_list("b")).alias("b"))  # two for each pass
    return best.select("row", F.get("b", F.lit(0))["cluster"].alias("cluster"), F.get("b", F.lit(0))["d"].alias("near"), F.get("b", F.lit(1))["d"].alias("far"))


def _bounds(found: DataFrame) -> DataFrame:
    return found.select("row", "cluster", F.sqrt("near").alias("upper"), F.sqrt("far").alias("lower"))


def means(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cluster, centroid) of the points (cluster, x); a cluster without points keeps its centroid."""
    long = points.select("cluster", F.posexplode("x").alias("dim", "v")).groupBy("cluster", "dim").agg(F.avg("v").alias("v"))
    new = long.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("_new"))
    return centroids.join(new, "cluster", "left").select("cluster", F.coalesce("_new", "centroid").alias("centroid"))


def pruned_lloyd(points: DataFrame, centroids: DataFrame, *, rounds: int, features: str = "features", max_bytes: int = BROADCAST_BYTES, block: int = CENTROIDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rounds`` Lloyd iterations and a last assignment: (points with cluster and distance, centroids, report).

    ``centroids``: cluster (int), centroid (array<double>). Results are those of
    ``cluster.lloyd_step`` and ``cluster.assign``, ties (in DIGITS of the
    squared distance) to the smaller cluster. ``report`` has a row per
    assignment: round (from 0), n_points, n_kept (no distance computed),
    n_own (one), n_scanned (all), share (of all distances that were computed).

    Plan: the state (row, x, cluster, bounds) is a written table. A round joins
    it with a row per cluster (moved, and the distance to the nearest other
    centroid), broadcast only if it is small; points that are left go through
    ``two_nearest``. Points without features, or without a centroid to go to,
    have no row.
    """
    rows = saved(points.withColumn("_row", F.monotonically_increasing_id()).where(F.col(features).isNotNull()), "lloyd-points")
    x = rows.select(F.col("_row").alias("row"), F.col(features).cast("array<double>").alias("x"))
    centroids = saved(centroids.select(F.col("cluster").cast("int").alias("cluster"), F.col("centroid").cast("array<double>").alias("centroid")), "lloyd-centroids")
    dims = (centroids.agg(F.max(F.size("centroid"))).first()[0]) or 0
    k, n = centroids.count(), x.count()
    state = saved(x.join(_bounds(two_nearest(x, centroids, dims=dims, max_bytes=max_bytes, block=block)), "row"), "lloyd-state")
    report = [(0, n, 0, 0, n if k else 0, 1.0)]
    for at in range(1, rounds + 1):
        old, centroids = centroids, saved(means(state, centroids), "lloyd-centroids")
        as_points = centroids.select(F.col("cluster").cast("long").alias("row"), F.col("centroid").alias("x"))
        apart = two_nearest(as_points, centroids, dims=dims, max_bytes=max_bytes, block=block).select(F.col("row").cast("int").alias("cluster"), F.sqrt("far").alias("apart"))
        moved = F.sqrt(squared_distance(F.col("centroid"), F.col("old")))
        per = saved(centroids.join(old.select("cluster", F.col("centroid").alias("old")), "cluster").join(apart, "cluster").select("cluster", "centroid", moved.alias("moved"), "apart"), "lloyd-moves")
        most = per.agg(F.max("moved").alias("most"))
        met = state.join(broadcast_if_small(per, max_bytes=max_bytes), "cluster").join(F.broadcast(most))
        clear = lambda upper: _clear(F.col(upper), F.greatest(F.col("lower"), F.col("apart") - F.col(upper)))
        met = met.withColumn("upper", F.col("upper") + F.col("moved")).withColumn("lower", F.greatest(F.lit(0.0), F.col("lower") - F.col("most")))
        met = met.withColumn("kept", clear("upper")).withColumn("own", F.when(F.col("kept"), F.col("upper")).otherwise(F.sqrt(squared_distance(F.col("x"), F.col("centroid")))))
        met = saved(met.select("row", "x", "cluster", F.col("own").alias("upper"), "lower", "kept", clear("own").alias("fine")), "lloyd-bounds")
        open_ = met.where("NOT fine").select("row", "x")
        found = _bounds(two_nearest(open_, centroids, dims=dims, max_bytes=max_bytes, block=block))
        counts = met.agg(F.count_if("kept").alias("a"), F.count_if(F.expr("fine AND NOT kept")).alias("b"), F.count_if(F.expr("NOT fine")).alias("c")).first()
        computed = counts["b"] + counts["c"] * (1 + k)
        report.append((at, n, counts["a"], counts["b"], counts["c"], computed / max(1, n * k)))
        state = saved(met.where("fine").select("row", "x", "cluster", "upper", "lower").unionByName(open_.join(found, "row").select("row", "x", "cluster", "upper", "lower")), "lloyd-state")
    last = state.join(broadcast_if_small(centroids, max_bytes=max_bytes), "cluster").select(F.col("row").alias("_at"), F.col("cluster").alias("_cluster"), F.sqrt(F.round(squared_distance(F.col("x"), F.col("centroid")), DIGITS)).alias("_distance"))
    others = [c for c in rows.columns if c not in ("_row", "cluster", "distance")]
    out = rows.join(last, F.col("_row") == F.col("_at")).select(*others, F.col("_cluster").alias("cluster"), F.col("_distance").alias("distance"))
    told = points.sparkSession.createDataFrame(report, "round int, n_points long, n_kept long, n_own long, n_scanned long, share double")
    return out, centroids, told


def _clear(upper: Column, lower: Column) -> Column:
    """Whether the bounds are apart by more than what counts as a tie, and by what rounding can make of them."""
    return (lower > 0) & (lower * lower * (1 - 1e-9) - upper * upper * (1 + 1e-9) > _TIE)
