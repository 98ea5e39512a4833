"""Affinity propagation by blocks of rows (C4), for more points than one task may hold.

The messages r (responsibility) and a (availability) of every two points are
kept as blocks of rows in a written table. What a round needs from other blocks
is one sum and one diagonal value a point; similarities are computed again from
the points. A pass over the blocks ends one round and begins the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.operators.quantiles import exact_medians
from seqlab.sources.scratch import delete, new_path, saved

#: Bytes of one message matrix of a block, and of all points, which each task gets.
BLOCK_BYTES, POINT_BYTES = 1 << 24, 1 << 27
STATE = "lo long, r binary, a binary, sums binary, diagonal binary, chosen binary"


def _similar(x: np.ndarray, lo: int, hi: int, preference: float) -> np.ndarray:
    """Rows lo to hi of the similarities, the preference on the diagonal."""
    out = np.empty((hi - lo, len(x)))
    for i in range(lo, hi):
        gap = x - x[i]
        out[i - lo] = -(gap * gap).sum(axis=1)
    out[np.arange(hi - lo), np.arange(lo, hi)] = preference
    return out


def _respond(s: np.ndarray, r: np.ndarray, a: np.ndarray, damping: float) -> np.ndarray:
    """Responsibilities of rows: similarity minus the best of what others offer."""
    t = a + s
    rows = np.arange(len(t))
    best = t.argmax(axis=1)
    first = t[rows, best]
    t[rows, best] = -np.inf
    second = t.max(axis=1)
    new = s - first[:, None]
    new[rows, best] = s[rows, best] - second if t.shape[1] > 1 else 0.0
    return damping * r + (1 - damping) * new


def _begin(size: int, points, preference: float, damping: float):
    """The first responsibilities, of blocks that start at the numbers given."""

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in batch.column("lo").to_pylist():
                x = points.value
                s = _similar(x, lo, min(lo + size, len(x)), preference)
                yield _row(lo, _respond(s, np.zeros_like(s), np.zeros_like(s), damping), np.zeros_like(s), np.zeros(len(s), bool))

    return begin


def _row(lo: int, r: np.ndarray, a: np.ndarray, chosen: np.ndarray) -> pa.RecordBatch:
    at = np.arange(len(r))
    positive = np.maximum(r, 0)
    positive[at, lo + at] = 0
    values = [r.tobytes(), a.tobytes(), positive.sum(axis=0).tobytes(), r[at, lo + at].tobytes(), chosen.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([lo], pa.int64()), *(pa.array([v], pa.binary()) for v in values)], names=[c.split()[0] for c in STATE.split(", ")])


def _pass(points, columns, preference: float, damping: float):
    """Availabilities of the round before, from its sums; who is chosen then; responsibilities of the next round."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, diagonal = columns.value
        x = points.value
        for batch in batches:
            for i in range(batch.num_rows):
                lo = batch.column("lo")[i].as_py()
                r, a = (np.frombuffer(batch.column(c)[i].as_py()).reshape(-1, len(x)) for c in ("r", "a"))
                at = np.arange(len(r))
                new = np.minimum(0, diagonal[None] + sums[None] - np.maximum(r, 0))
                new[at, lo + at] = sums[lo + at]
                a = damping * a + (1 - damping) * new
                chosen = (a + r)[at, lo + at] > 0
                yield _row(lo, _respond(_similar(x, lo, lo + len(r), preference), r, a, damping), a, chosen)

    return go


def propagate(points: DataFrame, *, key: str = "id", features: str = "features", damping: float = 0.5, max_iter: int = 200, stable: int = 15, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Affinity propagation on negative squared Euclidean distances, median preference: key (as string), cluster, exemplar.

    As ``cluster.affinity_propagation``, whose rounds it follows: it ends when the
    exemplars, of which there is one at least, stay the same for ``stable``
    rounds. Points without features are left out; keys are distinct.

    Plan: a task holds some blocks of rows, of ``block_bytes`` a matrix, one
    after another, and all points (at most POINT_BYTES, else ValueError); two
    numbers a point and round go through the driver. Messages are written in
    each round, and those of the round before deleted.
    """
    spark = points.sparkSession
    rows = points.where(F.col(features).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(features).cast("array<double>").alias("x"))
    rows = saved(rows.repartitionByRange("key").sortWithinPartitions("key"), "affinity-points")
    size = rows.agg(F.sum(8 * F.size("x") + 64)).first()[0] or 0
    if size > POINT_BYTES:
        raise ValueError(f"points of {size} bytes are more than {POINT_BYTES}: use k-means")
    named = rows.orderBy("key").toPandas()  # bounded above
    n = len(named)
    schema = f"{key} string, cluster int, exemplar string"
    if not n:
        return spark.createDataFrame([], schema)
    x = np.array(named["x"].tolist(), float)
    shared = spark.sparkContext.broadcast(x)
    most = max(1, min(n, block_bytes // (8 * n)))
    starts = spark.range(0, n, most, numPartitions=min(-(-n // most), 4 * spark.sparkContext.defaultParallelism)).select(F.col("id").alias("lo"))

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in batch.column("lo").to_pylist():
                for i in range(lo, min(lo + most, n)):  # each pair once: a median is that of both directions
                    gap = shared.value[i + 1 :] - shared.value[i]
                    yield pa.RecordBatch.from_arrays([pa.array(-(gap * gap).sum(axis=1))], names=["s"])

    middle = exact_medians(starts.mapInArrow(halves, "s double"), [], "s").first()
    preference = middle["median"] if middle else 0.0

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_path(spark, "affinity")
        df.write.parquet(path)
        return spark.read.schema(STATE).parquet(path), path

    state, path = written(starts.mapInArrow(_begin(most, shared, preference, damping), STATE))
    seen, same = None, 0
    for _ in range(max_iter):
        sums, diagonal = np.zeros(n), np.zeros(n)
        for r in state.select("lo", "sums", "diagonal").toLocalIterator():
            own = np.frombuffer(r["diagonal"])
            sums += np.frombuffer(r["sums"])
            diagonal[r["lo"] : r["lo"] + len(own)] = own
        columns = spark.sparkContext.broadcast((sums, diagonal))
        old = path
        state, path = written(state.mapInArrow(_pass(shared, columns, preference, damping), STATE))
        delete(spark, old)
        marks = sorted((r["lo"], bytes(r["chosen"])) for r in state.select("lo", "chosen").collect())
        chosen = np.flatnonzero(np.frombuffer(b"".join(m for _, m in marks), bool))
        same = same + 1 if seen is not None and np.array_equal(chosen, seen) else 0
        seen = chosen
        if same >= stable and len(chosen):
            break
    delete(spark, path)
    if not len(seen):  # no point was chosen: the one that is nearest to all
        seen = np.array([int(np.argmin([((x - v) ** 2).sum() for v in x]))])
    exemplars = spark.sparkContext.broadcast((seen, x[seen], named["key"].to_numpy()[seen].tolist()))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centers, names = exemplars.value
        for batch in batches:
            label = []
            for v, k in zip(batch.column("x").to_pylist(), batch.column("key").to_pylist(), strict=True):
                label.append(names.index(k) if k in names else int(((centers - np.array(v, float)) ** 2).sum(axis=1).argmin()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(label, pa.int32()), pa.array([names[i] for i in label], pa.string())], names=[key, "cluster", "exemplar"])

    return rows.mapInArrow(assign, schema)
