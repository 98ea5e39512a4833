"""Centroid clustering: Lloyd's iterations over two cover trees.

Vectors are packed once, a cover tree for each block of rows; each round has a
cover tree of its centroids. Pairs of nodes are gone through together: a
centroid node that is farther from a vector node than the bound allows is left
for all vectors below, a vector node with one centroid left gives its sum and
count whole, and only leaves with several centroids left are compared vector by
vector, in exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import saved
from seqlab.llm.topk import quantized

#: Radii of a node's children are a level smaller.
BASE = 1.3
#: The largest magnitude of a component for which squared distances of 64 components are exact 64-bit integers.
LARGEST = 1 << 27
_CHUNK = 1 << 15


@dataclass
class Tree:
    """A cover tree; nodes are numbered so that a node's children follow one another, and its members are a range of ``order``."""

    order: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    kids: np.ndarray

    FIELDS = (("order", "<i4"), ("center", "<i4"), ("radius", "<f8"), ("lo", "<i4"), ("hi", "<i4"), ("first", "<i4"), ("kids", "<i4"))

    def packed(self) -> list[bytes]:
        return [getattr(self, f).astype(kind).tobytes() for f, kind in self.FIELDS]

    @classmethod
    def unpacked(cls, parts: list[bytes]) -> Tree:
        return cls(*(np.frombuffer(p, kind) for p, (_, kind) in zip(parts, cls.FIELDS, strict=True)))


def _distances(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    gap = (points - center).astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def cover_tree(points: np.ndarray, leaf: int = 32) -> Tree:
    """The cover tree of integer vectors; nodes of at most ``leaf`` members, or of equal ones if ``leaf`` is over 1, have no children.

    A node of level l has its members within BASE**l of its centre. The centre
    is the centre of its first child too; the children's are over BASE**(l-1)
    from one another, and have what is within it.
    """
    n = len(points)
    order = np.arange(n)
    center, radius, lo, hi, first, kids = [0], [], [0], [n], [], []
    gaps = [_distances(points, points[0])]
    node = 0
    while node < len(center):
        a, b, gap = lo[node], hi[node], gaps[node]
        gaps[node] = None
        far = float(gap.max())
        radius.append(far)
        first.append(len(center))
        if b - a <= leaf or (far == 0 and leaf > 1):
            kids.append(0)
            node += 1
            continue
        members = order[a:b].copy()
        reach = BASE ** (np.ceil(np.log(far) / np.log(BASE)) - 1) if far > 0 else -1.0
        parts, at, middle = [], a, center[node]
        while len(members):
            near = gap <= reach if far > 0 else np.arange(len(members)) == 0
            order[at : at + near.sum()] = members[near]
            parts.append((middle, at, at + int(near.sum()), gap[near]))
            at += int(near.sum())
            members = members[~near]
            if len(members):
                middle = members[0]
                gap = _distances(points[members], points[middle])
        kids.append(len(parts))
        for c, x, y, g in parts:
            center.append(c)
            lo.append(x)
            hi.append(y)
            gaps.append(g)
        node += 1
    return Tree(order, *(np.array(x) for x in (center, radius, lo, hi, first, kids)))


def _squared(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact squared distances of pairs."""
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), _CHUNK):
        s = slice(a, a + _CHUNK)
        gap = x[i[s]] - y[j[s]]
        out[s] = np.einsum("ij,ij->i", gap, gap)
    return out


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range, one after the other."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


@dataclass
class Found:
    """Nodes of one centroid (node, cluster); vectors that were compared (place in the tree's order, cluster, squared distance); distances computed."""

    nodes: list
    vectors: list
    computed: int = 0


def nearest(points: np.ndarray, tree: Tree, centroids: np.ndarray, over: Tree) -> Found:
    """The nearest centroid (ties: the smaller number) of all vectors, by going through pairs of nodes together.

    A vector node's bound is the largest distance that one of its members can
    have to its nearest centroid: distance of the centres plus its radius, the
    least over the centroid nodes met so far (a centroid node's centre is a
    centroid). The node with the larger radius is opened.
    """
    out = Found([], [])
    if not len(points) or not len(centroids):
        return out
    single = over.hi - over.lo == 1
    q, bound = np.zeros(1, np.int64), np.full(1, np.inf)
    pq, pr = np.zeros(1, np.int64), np.zeros(1, np.int64)  # pairs: place in q (ascending), centroid node
    while len(q):
        d = np.sqrt(_squared(points, tree.center[q[pq]], centroids, over.center[pr]).astype(np.float64))
        out.computed += len(d)
        starts = np.flatnonzero(np.concatenate([[True], pq[1:] != pq[:-1]]))
        bound = np.minimum(bound, np.minimum.reduceat(d + tree.radius[q][pq], starts))
        # what rounding can make of the bounds is allowed for, so that ties are compared
        keep = d - tree.radius[q][pq] - over.radius[pr] <= bound[pq] * (1 + 1e-9) + 1e-6
        pq, pr = pq[keep], pr[keep]
        starts = np.flatnonzero(np.concatenate([[True], pq[1:] != pq[:-1]]))
        n = np.diff(np.append(starts, len(pq)))
        widest = np.maximum.reduceat(np.where(single[pr], -1.0, over.radius[pr]), starts)
        leaf = tree.kids[q] == 0
        settled = (n == 1) & single[pr[starts]]
        if settled.any():
            out.nodes.append((q[settled], over.order[over.lo[pr[starts[settled]]]]))
        wide = ~settled & (widest >= 0) & (leaf | (widest > tree.radius[q]))
        compared = ~settled & ~wide & leaf
        if compared.any():
            out.computed += _compare(points, tree, centroids, over, q, pq, pr, compared, out)
        down = ~settled & ~wide & ~leaf
        # centroid nodes opened: their children in their place
        mine = wide[pq]
        a, r = pq[mine], pr[mine]
        opens = ~single[r] & (leaf[a] | (over.radius[r] > tree.radius[q][a]))
        times = np.where(opens, over.kids[r], 1)
        wide_pq, wide_pr = np.repeat(a, times), _ranges(np.where(opens, over.first[r], r), times)
        # vector nodes opened: each child with all the pairs of its parent
        at = np.flatnonzero(down)
        kids = tree.kids[q[at]]
        child, parent = _ranges(tree.first[q[at]], kids), np.repeat(at, kids)
        child_pairs = n[parent]
        down_pr = pr[_ranges(starts[parent], child_pairs)]
        kept = np.flatnonzero(wide)
        place = np.full(len(q), -1)
        place[kept] = np.arange(len(kept))
        q, bound = np.concatenate([q[kept], child]), np.concatenate([bound[kept], bound[parent]])
        pq = np.concatenate([place[wide_pq], len(kept) + np.repeat(np.arange(len(child)), child_pairs)])
        pr = np.concatenate([wide_pr, down_pr])
    return out


def _compare(points, tree, centroids, over, q, pq, pr, compared, out: Found) -> int:
    """Leaf pairs: every member with every centroid that is left."""
    mine = compared[pq]
    owner, number = pq[mine], over.order[over.lo[pr[mine]]]
    by = np.lexsort((number, owner))
    owner, number = owner[by], number[by]
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    n, nodes = np.diff(np.append(starts, len(owner))), q[owner[starts]]
    sizes = tree.hi[nodes] - tree.lo[nodes]
    place = _ranges(tree.lo[nodes], sizes)
    each = np.repeat(n, sizes)
    candidate = number[_ranges(np.repeat(starts, sizes), each)]
    d2 = _squared(points, tree.order[np.repeat(place, each)], centroids, candidate)
    heads = np.cumsum(each) - each
    least = np.minimum.reduceat(d2, heads)
    best = np.flatnonzero(d2 == np.repeat(least, each))
    of = np.searchsorted(heads, best, side="right") - 1
    _, firsts = np.unique(of, return_index=True)  # the first of equal ones has the smaller number
    out.vectors.append((place, candidate[best[firsts]], least))
    return len(d2)


TREES = "ids array<long>, points binary, " + ", ".join(f"t_{f} binary" for f, _ in Tree.FIELDS)


def _pack(block: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(table: pa.Table) -> pa.RecordBatch:
            column = table.column("weights").combine_chunks()
            points = column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
            if np.abs(points).max(initial=0) > LARGEST:
                raise ArithmeticError(f"components above {LARGEST} have no exact 64-bit distances")
            tree = cover_tree(points)
            values = [pa.array([table.column("vec_id").to_pylist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (points.astype("<i4").tobytes(), *tree.packed()))]
            return pa.RecordBatch.from_arrays(values, names=[x.split()[0] for x in TREES.split(", ")])

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for a in range(0, batch.num_rows, block):
                part = batch.slice(a, block)
                if held and rows + part.num_rows > block:
                    yield packed(pa.Table.from_batches(held))
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield packed(pa.Table.from_batches(held))

    return pack


def _unpack(batch: pa.RecordBatch, i: int, dims: int) -> tuple[np.ndarray, Tree, np.ndarray, Tree]:
    def side(points: str, prefix: str) -> tuple[np.ndarray, Tree]:
        values = np.frombuffer(batch.column(points)[i].as_py(), "<i4").reshape(-1, dims).astype(np.int64)
        return values, Tree.unpacked([batch.column(prefix + f)[i].as_py() for f, _ in Tree.FIELDS])

    return *side("points", "t_"), *side("c_points", "c_")


def _sums(dims: int):
    """Count and sum of each cluster, over all blocks of a task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = total = None
        for batch in batches:
            for i in range(batch.num_rows):
                points, tree, centroids, over = _unpack(batch, i, dims)
                if count is None:
                    count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
                found = nearest(points, tree, centroids, over)
                before = np.zeros((len(points) + 1, dims), np.int64)
                np.cumsum(points[tree.order], axis=0, out=before[1:])
                for nodes, cluster in found.nodes:
                    np.add.at(count, cluster, (tree.hi - tree.lo)[nodes].astype(np.int64))
                    np.add.at(total, cluster, before[tree.hi[nodes]] - before[tree.lo[nodes]])
                for place, cluster, _ in found.vectors:
                    np.add.at(count, cluster, 1)
                    np.add.at(total, cluster, points[tree.order[place]])
        if count is not None:
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    return sums


def _members(dims: int):
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                points, tree, centroids, over = _unpack(batch, i, dims)
                found = nearest(points, tree, centroids, over)
                cluster, distance = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
                for nodes, numbers in found.nodes:
                    sizes = tree.hi[nodes] - tree.lo[nodes]
                    at, own = tree.order[_ranges(tree.lo[nodes], sizes)], np.repeat(numbers, sizes)
                    cluster[at], distance[at] = own, _squared(points, at, centroids, own)
                for place, numbers, d2 in found.vectors:
                    cluster[tree.order[place]], distance[tree.order[place]] = numbers, d2
                ids = batch.column("ids").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return members


CENTROIDS = "c_points binary, " + ", ".join(f"c_{f} binary" for f, _ in Tree.FIELDS)


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The centroids, as one row with their tree."""
    for batch in batches:
        for rows in batch.column("rows").to_pylist():
            points = np.array([r["centroid"] for r in rows], np.int64)
            parts = [points.astype("<i4").tobytes(), *cover_tree(points, leaf=1).packed()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], names=[x.split()[0] for x in CENTROIDS.split(", ")])


def dual_tree_lloyd(vectors: DataFrame, centroids: DataFrame, *, dims: int, rounds: int = 10, block: int = 2048, max_centroid_bytes: int = 1 << 27) -> tuple[DataFrame, DataFrame]:
    """``rounds`` Lloyd iterations, then a last assignment: (vec_id, cluster, distance) and the final (cluster, centroid).

    ``vectors``: vec_id, weights (array<long> of ``dims`` components);
    ``centroids``: cluster (0, 1, ...), centroid (array<long>). A vector goes to
    the nearest centroid by squared Euclidean distance, ties to the smaller
    number; then a centroid that has vectors becomes floor(sum / count) of each
    component, and one that has none stays. All in exact integers.

    Edge cases: no vectors, no rows. Repeated vectors and null vec_ids are rows
    each. Components beyond 2**27 raise, as their distances are no 64-bit
    integers; so do more centroids than ``max_centroid_bytes`` hold.

    Plan: vectors are packed into blocks where they are read, without a shuffle
    and whatever their keys, and the trees are written once. The centroids, the
    caller's k in number, are one broadcast row of checked size. Each task
    gives a row per cluster, so that a round shuffles k rows a task.
    """
    trees = saved(vectors.select("vec_id", "weights").mapInArrow(_pack(block), TREES), "centroids-trees")
    current = saved(centroids.select(F.col("cluster").cast("int").alias("cluster"), F.col("centroid").cast("array<long>").alias("centroid")), "centroids")
    if current.count() * (dims + 8) * 8 > max_centroid_bytes:
        raise ValueError("the centroids exceed max_centroid_bytes")

    def met() -> DataFrame:
        row = current.agg(F.array_sort(F.collect_list(F.struct("cluster", "centroid"))).alias("rows")).where(F.size("rows") > 0)
        return trees.join(F.broadcast(row.mapInArrow(_plant, CENTROIDS)))

    for _ in range(rounds):
        part = met().mapInArrow(_sums(dims), "cluster int, n long, total array<long>")
        dim = part.select("cluster", "n", F.posexplode("total").alias("dim", "x")).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        # integer division rounds towards zero, so the remainder goes first
        floors = dim.select("cluster", "dim", F.expr("(x - pmod(x, n)) div n").alias("x"))
        moved = floors.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("moved"))
        current = saved(current.join(moved, "cluster", "left").select("cluster", F.coalesce("moved", "centroid").alias("centroid")), "centroids")
    return met().mapInArrow(_members(dims), "vec_id long, cluster int, distance long"), current


def cluster_vectors(vectors: DataFrame, *, k: int = 8, dims: int = 64, scale: int = 1024, rounds: int = 10, salt: str = "3:", vector: str = "embedding") -> DataFrame:
    """Clusters of vectors of exactly ``dims`` finite components, each taken as floor(scale * x).

    Centroids 0, 1, ... start as the ``k`` vectors (all, if fewer) of smallest
    sha256 of ``salt`` and the vec_id, equal ones by vec_id and components.
    Returns per vector: vec_id, cluster, distance (squared), cluster_inertia and
    inertia (sums of distances), centroid_sha256 (of the final centroid's
    components, joined by commas).

    Edge cases: vectors that are null, of another length, or hold a null or
    non-finite component have no row; a null vec_id counts as empty text in the
    hash. Otherwise as ``dual_tree_lloyd``.
    """
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantized(F.col(vector), scale).alias("weights")).where(F.col("weights").isNotNull() & (F.size("weights") == dims))
    named = kept.withColumn("h", F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256))
    seeds = named.orderBy("h", "vec_id", "weights").limit(k).agg(F.array_sort(F.collect_list(F.struct("h", "vec_id", "weights"))).alias("s"))
    seeds = seeds.select(F.posexplode("s").alias("cluster", "s")).select("cluster", F.col("s.weights").alias("centroid"))
    assigned, centroids = dual_tree_lloyd(kept, seeds, dims=dims, rounds=rounds)
    assigned = saved(assigned, "centroids-members")
    inertia = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    hashed = centroids.select("cluster", F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256).alias("centroid_sha256"))
    # a row for each of the k clusters
    stats = inertia.join(F.broadcast(hashed), "cluster").join(F.broadcast(inertia.agg(F.sum("cluster_inertia").alias("inertia"))))
    return assigned.join(F.broadcast(stats), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
