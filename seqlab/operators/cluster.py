"""Clustering of labels across experiments and its upkeep.

Vectors are (id, features array<double>). Labels of all experiments are few
next to frames; still, points are never gathered: distances are computed
against centroids, whose number is the caller's k.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlab.operators import affinity
from seqlab.operators.lloyd import DIGITS, pruned_lloyd, squared_distance
from seqlab.operators.silhouettes import BLOCK, silhouette_curve, silhouette_samples
from seqlab.sources.scratch import saved


def assign(points: DataFrame, centroids: DataFrame, *, features: str = "features", digits: int = DIGITS, max_bytes: int = 1 << 20) -> DataFrame:
    """Each point with its nearest centroid (J9, C5, S6): cluster and distance; ties (in ``digits`` of the square) go to the smaller cluster.

    Up to ``max_bytes`` all centroids come as one broadcast row; more of them
    come in blocks (``lloyd.two_nearest``). No point is repeated for each.
    """
    size = centroids.agg(F.coalesce(F.sum(F.size("centroid") * 8 + 16), F.lit(0))).first()[0]
    if size > max_bytes:
        return pruned_lloyd(points, centroids, rounds=0, features=features)[0]
    table = centroids.agg(F.array_sort(F.collect_list(F.struct("cluster", F.col("centroid")))).alias("_c"))
    near = F.transform("_c", lambda c: F.struct(F.round(squared_distance(F.col(features), c["centroid"]), digits).alias("d2"), c["cluster"].alias("cluster")))
    out = points.join(F.broadcast(table)).withColumn("_n", F.array_min(near)).drop("_c")
    return out.withColumn("cluster", F.col("_n.cluster")).withColumn("distance", F.sqrt("_n.d2")).drop("_n")


def flag_new(assigned: DataFrame, *, threshold: float = 0.65) -> DataFrame:
    """Adds cluster_candidate: farther than the threshold from every centroid."""
    return assigned.withColumn("cluster_candidate", F.col("distance") > threshold)


def lloyd_step(points: DataFrame, centroids: DataFrame, *, features: str = "features") -> DataFrame:
    """Centroids after one Lloyd iteration (C7): the mean of their points; an empty cluster keeps its centroid."""
    long = assign(points, centroids, features=features).select("cluster", F.posexplode(features).alias("dim", "x"))
    mean = long.groupBy("cluster", "dim").agg(F.avg("x").alias("x")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("_new"))
    return centroids.join(mean, "cluster", "left").select("cluster", F.coalesce("_new", "centroid").alias("centroid"))


def update_centroids(old: DataFrame, new: DataFrame, centroids: DataFrame, *, max_iter: int = 2, features: str = "features") -> tuple[DataFrame, DataFrame]:
    """A few warm Lloyd iterations over old and new points (C7, C8): (points with origin and cluster, centroids)."""
    points = old.withColumn("origin", F.lit("old")).unionByName(new.withColumn("origin", F.lit("new")), allowMissingColumns=True)
    out, centroids, _ = pruned_lloyd(points, centroids, rounds=max_iter, features=features)
    return out, centroids


def add_clusters(old: DataFrame, flagged: DataFrame, centroids: DataFrame, *, most: int = 5, seed: int = 42, features: str = "features") -> tuple[DataFrame, DataFrame]:
    """New clusters for flagged points (C6), then one Lloyd iteration over all.

    Up to ``most`` clusters of k-means over the flagged points (their mean if
    there is one point, or ``most`` is 1) are appended after the largest id.
    """
    out = flagged.where("cluster_candidate").drop("distance")
    n = out.limit(most + 1).count()
    if n:
        k = min(most, n)
        if k < 2:
            means = out.select(F.posexplode(features).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("x"))
            fresh = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("centroid")).withColumn("_k", F.lit(0))
        else:
            fresh = kmeans(out, k, seed=seed, features=features)[1].withColumnRenamed("cluster", "_k")
        top = centroids.agg(F.coalesce(F.max("cluster"), F.lit(-1)).alias("_top"))
        fresh = fresh.join(F.broadcast(top)).select((F.col("_k") + F.col("_top") + 1).cast("int").alias("cluster"), "centroid")
        centroids = centroids.select(F.col("cluster").cast("int").alias("cluster"), "centroid").unionByName(fresh)
    points = flagged.drop("cluster", "distance", "cluster_candidate")
    return update_centroids(old, points, centroids, max_iter=1, features=features)


def pca(points: DataFrame, k: int = 20, *, features: str = "features") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Centred PCA (C1, A24): (points with ``pcs``, components, explained variance with its running sum).

    Components are signed so that their largest loading is positive. The
    library's PCA does not centre, so the mean is taken off first.
    """
    dims = points.select(F.posexplode(features).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"))
    mean = np.array([r["mean"] for r in dims.orderBy("dim").collect()])  # one number per feature
    k = min(k, len(mean))
    centre = F.array(*(F.lit(float(m)) for m in mean))
    centred = points.withColumn("_v", array_to_vector(F.zip_with(F.col(features), centre, lambda x, m: x - m)))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(centred)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    signs[signs == 0] = 1
    flip = F.array(*(F.lit(float(s)) for s in signs))
    out = model.transform(centred).withColumn("pcs", F.zip_with(vector_to_array("_p"), flip, lambda x, s: x * s)).drop("_v", "_p")
    spark = points.sparkSession
    components = spark.createDataFrame([(i + 1, (loadings[:, i] * signs[i]).tolist()) for i in range(k)], "component int, loadings array<double>")
    ratio = model.explainedVariance.toArray()
    variance = spark.createDataFrame([(i + 1, float(r), float(c)) for i, (r, c) in enumerate(zip(ratio, ratio.cumsum(), strict=True))], "component int, ratio double, cumulative double")
    return out, components, variance


def _kmeans_model(vectors: DataFrame, k: int, seed: int, to: str = "cluster"):
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol=to).fit(vectors)


def kmeans(points: DataFrame, k: int, *, seed: int = 0, features: str = "features") -> tuple[DataFrame, DataFrame]:
    """k-means (C2): (points with ``cluster``, centroids (cluster, centroid))."""
    vectors = points.drop("cluster").withColumn("_v", array_to_vector(features))
    model = _kmeans_model(vectors, k, seed)
    centroids = points.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "cluster int, centroid array<double>")
    return model.transform(vectors).drop("_v"), centroids


def silhouettes(points: DataFrame, *, key: str = "id", features: str = "features", block: int = BLOCK) -> DataFrame:
    """Euclidean silhouette of each point (C3): key, cluster, silhouette; a cluster of one has 0."""
    samples = silhouette_samples(points, ["cluster"], key=key, features=features, block=block)
    own = points.select(F.col(key).cast("string").alias("_key"), "cluster")
    return samples.join(own, F.col("key") == F.col("_key")).select(F.col("key").alias(key), "cluster", F.get("silhouettes", F.lit(0)).alias("silhouette"))


def choose_k(points: DataFrame, *, seed: int = 0, features: str = "features", key: str = "id", least: int = 20, most: int = 300, step: int = 3) -> DataFrame:
    """Mean silhouette for each k in range(least, min(most, n // 2), step) (C3); the best is the first by (silhouette desc, k) (S4). Raises if there is no such k.

    Every k has its own fit, but distances between points are computed once for all of them.
    """
    n = points.count()
    ks = range(least, min(most, n // 2), step)
    if not ks:
        raise ValueError(f"{n} points allow no k from {least}: give the number of clusters")
    fitted = saved(points.select(F.col(key).alias("id"), F.col(features).alias("features")).withColumn("_v", array_to_vector("features")), "points")
    found = fitted
    for k in ks:
        found = _kmeans_model(fitted, k, seed, f"k{k}").transform(found)
    curve = silhouette_curve(found.drop("_v"), {k: f"k{k}" for k in ks})
    return curve.select("k", "silhouette").orderBy(F.desc("silhouette"), "k")


def affinity_propagation(points: DataFrame, *, key: str = "id", features: str = "features", damping: float = 0.5, max_iter: int = 200, stable: int = 15, most: int = 5000) -> DataFrame:
    """Affinity propagation on negative squared Euclidean distances, median preference (C4): key, cluster, exemplar.

    Up to ``most`` points the messages are one task's matrices; more points go
    through ``affinity.propagate``, whose messages are blocks of rows.
    """
    n = points.limit(most + 1).count()
    if n > most:
        return affinity.propagate(points, key=key, features=features, damping=damping, max_iter=max_iter, stable=stable)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)
        x = np.array(pdf["x"].tolist(), float)
        m = len(x)
        s = -((x[:, None] - x[None]) ** 2).sum(axis=2)
        np.fill_diagonal(s, np.median(s[~np.eye(m, dtype=bool)]) if m > 1 else 0.0)
        r, a, seen, same = np.zeros((m, m)), np.zeros((m, m)), None, 0
        rows = np.arange(m)
        for _ in range(max_iter):
            t = a + s
            best = t.argmax(axis=1)
            first = t[rows, best]
            t[rows, best] = -np.inf
            second = t.max(axis=1)
            new = s - first[:, None]
            new[rows, best] = s[rows, best] - second if m > 1 else 0.0
            r = damping * r + (1 - damping) * new
            p = np.maximum(r, 0)
            p[rows, rows] = r[rows, rows]
            new = p.sum(axis=0)[None] - p
            diagonal = new[rows, rows].copy()
            new = np.minimum(new, 0)
            new[rows, rows] = diagonal
            a = damping * a + (1 - damping) * new
            chosen = np.flatnonzero((a + r)[rows, rows] > 0)
            same = same + 1 if seen is not None and np.array_equal(chosen, seen) else 0
            seen = chosen
            if same >= stable and len(chosen):
                break
        if seen is None or not len(seen):
            seen = np.array([int(s.sum(axis=0).argmax())])
        label = s[:, seen].argmax(axis=1)
        label[seen] = np.arange(len(seen))
        return pd.DataFrame({"key": pdf["key"], "cluster": label.astype("int32"), "exemplar": pdf["key"].to_numpy()[seen[label]]})

    out = points.select(F.col(key).cast("string").alias("key"), F.col(features).alias("x")).withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda pdf: run(pdf), "key string, cluster int, exemplar string")
    return out.withColumnRenamed("key", key)


def contingency(assigned: DataFrame, truth: DataFrame, *, on: Sequence[str], label: str = "ground_truth_label", cluster: str = "cluster") -> DataFrame:
    """Counts of (label, cluster) with the cluster's size (J2, A12), long form; larger clusters first when ordered by (cluster_size desc, cluster)."""
    n = assigned.join(truth, list(on)).groupBy(label, cluster).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("cluster_size", F.sum("n").over(Window.partitionBy(cluster)))


def cluster_uniqueness(assigned: DataFrame, *, label: str = "ground_truth_label", cluster: str = "cluster", top: int = 5) -> DataFrame:
    """Size over number of distinct labels of clusters of more than one, the ``top`` highest."""
    out = assigned.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(label).alias("n_labels")).where("n > 1")
    return out.withColumn("uniqueness", F.try_divide("n", "n_labels")).orderBy(F.desc("uniqueness"), cluster).limit(top)


def split_quality(rows: DataFrame, *, quality: str = "syllable_quality", low: str = "Low") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) rows by quality (F12); a missing quality is kept."""
    bad = F.coalesce(F.col(quality) == low, F.lit(False))
    return rows.where(~bad), rows.where(bad)


def apply_classifiers(rows: DataFrame, pipelines: dict[str, object], train_columns: Sequence[str]) -> DataFrame:
    """Adds a prediction column for each fitted Spark ML pipeline, or bundle of tables (``forests.TreeBundle``) (C9). Raises if training columns are missing."""
    from seqlab.operators.normalize import missing_columns

    if lacking := missing_columns(rows, train_columns):
        raise ValueError(f"columns missing: {lacking}")
    for name, model in pipelines.items():
        scored = model.transform(rows)
        rows = scored.select(*rows.columns, F.col("prediction").alias(name))
    return rows
