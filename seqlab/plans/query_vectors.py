"""Queries over ``embeddings`` as component scores and label features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlab.operators import cluster, features, lloyd, silhouettes, similarity
from seqlab.plans.register import query, table


def points(spark: SparkSession, sf_dir: str, n: int = 64) -> DataFrame:
    """id, label, features (double)."""
    v = F.transform(F.slice("embedding", 1, n), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", v.alias("features"))


#: The first four vectors are the centroids.
A_SQL = """
l AS (SELECT vec_id AS id, label, unnest(range(64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
ce AS (SELECT id AS cluster, d, x FROM l WHERE id < 4),
di AS (SELECT l.id, ce.cluster, round(sum((l.x - ce.x) * (l.x - ce.x)), 9) AS d2 FROM l JOIN ce USING (d) GROUP BY ALL),
asg AS (SELECT id, arg_min(cluster, struct_pack(d2 := d2, c := cluster)) AS cluster, sqrt(min(d2)) AS distance FROM di GROUP BY id)"""


def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where("id < 4").select(F.col("id").alias("cluster"), F.col("features").alias("centroid"))


@query("SELECT label, " + ", ".join(f"round(avg(embedding[{i}]::DOUBLE), 6) AS avg_pc_{i}, round(stddev_samp(embedding[{i}]::DOUBLE), 6) AS std_pc_{i}" for i in range(1, 11)) + " FROM embeddings GROUP BY label")
def pc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    onsets = points(spark, sf_dir, 10).withColumn("run_frames", F.lit(1))
    out = features.label_features(onsets, [], pc="features")
    return out.select("label", *(F.round(f"{s}_pc_{i}", 6).alias(f"{s}_pc_{i}") for i in range(1, 11) for s in ("avg", "std")))


@query("WITH s AS (SELECT avg(embedding[1]::DOUBLE) AS a, stddev_pop(embedding[1]::DOUBLE) AS b, avg(embedding[2]::DOUBLE) AS c, stddev_pop(embedding[2]::DOUBLE) AS d FROM embeddings) SELECT vec_id AS id, round((embedding[1]::DOUBLE - a) / b, 6) AS z_pc_1, round((embedding[2]::DOUBLE - c) / d, 6) AS z_pc_2 FROM embeddings, s")
def pc_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir, 10).select("id", *(F.get("features", F.lit(i)).alias(f"pc_{i + 1}") for i in range(2)))
    return similarity.zscore(rows, ["pc_1", "pc_2"], population=True).select("id", F.round("z_pc_1", 6).alias("z_pc_1"), F.round("z_pc_2", 6).alias("z_pc_2"))


@query(
    "WITH s AS (SELECT " + ", ".join(f"avg(embedding[{i}]::DOUBLE) AS m{i}, stddev_pop(embedding[{i}]::DOUBLE) AS s{i}" for i in range(1, 11)) + " FROM embeddings) SELECT vec_id AS id, "
    + ", ".join(f"round((embedding[{i}]::DOUBLE - m{i}) / s{i}, 6) AS z_pc_{i}" for i in range(1, 11)) + " FROM embeddings, s"
)
def pc_zscore_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten components that V9 scales; ``pc_zscore`` has the two of its SQL."""
    names = [f"pc_{i}" for i in range(1, 11)]
    rows = points(spark, sf_dir, 10).select("id", *(F.get("features", F.lit(i)).alias(c) for i, c in enumerate(names)))
    return similarity.zscore(rows, names, population=True).select("id", *(F.round(f"z_{c}", 6).alias(f"z_{c}") for c in names))


@query(
    """WITH l AS (SELECT label, unnest(range(10)) AS d, CAST(unnest(list_slice(embedding, 1, 10)) AS DOUBLE) AS x FROM embeddings), m AS (SELECT label, d, avg(x) AS x FROM l GROUP BY ALL)
SELECT a.label AS i, b.label AS j, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 6) AS similarity FROM m a JOIN m b USING (d) GROUP BY a.label, b.label"""
)
def label_vector_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.label_cosine(points(spark, sf_dir), "label", "features", 10).withColumn("similarity", F.round("similarity", 6))


@query("WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(list_slice(embedding, 1, 8), lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings) SELECT vec_id AS id, " + ", ".join(f"round(embedding[{i}]::DOUBLE / norm, 6) AS x{i}" for i in range(1, 9)) + " FROM n")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similarity.l2_normalize(points(spark, sf_dir, 8), "features")
    return out.select("id", *(F.round(F.get("features", F.lit(i)), 6).alias(f"x{i + 1}") for i in range(8)))


@query(
    """WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings),
l AS (SELECT vec_id, norm, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM n)
SELECT vec_id AS id, CAST(dim AS INTEGER) AS dim, round(CASE WHEN norm > 0 THEN x / norm ELSE x END, 6) AS x FROM l"""
)
def l2_normalize_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole vectors (V15), a row per component; ``l2_normalize`` has the first eight of its SQL."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    return similarity.l2_normalize(vectors, "features").select("id", F.posexplode("features").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query(f"WITH {A_SQL} SELECT id, cluster, round(distance, 6) AS distance FROM asg")
def assign_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.assign(points(spark, sf_dir), _centroids(spark, sf_dir)).select("id", "cluster", F.round("distance", 6).alias("distance"))


@query(f"WITH {A_SQL} SELECT cluster, distance > 1.1 AS cluster_candidate, count(*) AS n FROM asg GROUP BY ALL")
def new_cluster_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster.flag_new(cluster.assign(points(spark, sf_dir), _centroids(spark, sf_dir)), threshold=1.1)
    return out.groupBy("cluster", "cluster_candidate").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {A_SQL} SELECT cluster, CAST(d AS INTEGER) AS dim, round(avg(x), 6) AS x FROM asg JOIN l USING (id) GROUP BY ALL")
def lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster.lloyd_step(points(spark, sf_dir), _centroids(spark, sf_dir))
    return out.select("cluster", F.posexplode("centroid").alias("dim", "x")).withColumn("x", F.round("x", 6))


def _lloyd_sql(rounds: int) -> str:
    near = """a{i} AS MATERIALIZED (SELECT id, arg_min(cluster, struct_pack(d2 := d2, c := cluster)) AS cluster, min(d2) AS d2 FROM (
  SELECT l.id, c.cluster, round(sum((l.x - c.x) * (l.x - c.x)), 9) AS d2 FROM l JOIN c{i} c USING (d) GROUP BY ALL) GROUP BY id)"""
    step = """,
c{i} AS MATERIALIZED (SELECT cluster, d, avg(x) AS x FROM a{p} JOIN l USING (id) GROUP BY ALL),
"""
    text = "WITH l AS MATERIALIZED (SELECT vec_id AS id, unnest(range(64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),\nc0 AS (SELECT id AS cluster, d, x FROM l WHERE id < 4),\n"
    text += near.format(i=0) + "".join(step.format(i=i, p=i - 1) + near.format(i=i) for i in range(1, rounds + 1))
    return f"{text}\nSELECT id, cluster, round(sqrt(d2), 6) AS distance FROM a{rounds}"


@query(_lloyd_sql(3))
def lloyd_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pruned Lloyd iterations and the assignment that follows."""
    out, _, _ = lloyd.pruned_lloyd(points(spark, sf_dir), _centroids(spark, sf_dir), rounds=3)
    return out.select("id", F.col("cluster").cast("long").alias("cluster"), F.round("distance", 6).alias("distance"))


@query(
    """WITH l AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.id, a.label, b.label AS other, list_distance(a.e, b.e) AS d FROM l a CROSS JOIN l b),
s AS (SELECT id, label, other, sum(d) AS t, count(*) AS n FROM p GROUP BY ALL),
ab AS (SELECT id, label, max(CASE WHEN label = other AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN label <> other THEN t / n END) AS b FROM s GROUP BY ALL)
SELECT id, label AS cluster, round(coalesce((b - a) / greatest(a, b), 0), 5) AS silhouette FROM ab"""
)
def silhouette_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster.silhouettes(points(spark, sf_dir).withColumnRenamed("label", "cluster"))
    return out.select(F.col("id").cast("long").alias("id"), "cluster", F.round("silhouette", 5).alias("silhouette"))


@query(
    """WITH l AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.id, a.label, b.label AS other, sum(list_distance(a.e, b.e)) AS t, count(*) AS n FROM l a CROSS JOIN l b GROUP BY ALL),
s AS (SELECT id, k, label % k AS c, other % k AS o, sum(t) AS t, sum(n) AS n FROM p, (SELECT unnest([2, 3, 5, 7]) AS k) GROUP BY ALL),
ab AS (SELECT id, k, max(CASE WHEN c = o AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN c <> o THEN t / n END) AS b FROM s GROUP BY ALL),
m AS (SELECT k, avg(coalesce((b - a) / greatest(a, b), 0)) AS s FROM ab GROUP BY k)
SELECT k, round(s, 7) AS silhouette, row_number() OVER (ORDER BY s DESC, k) = 1 AS best FROM m"""
)
def silhouette_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The silhouette curve of four clusterings and its first maximum (C3, S4), all from one pass of distances."""
    p = points(spark, sf_dir)
    out = silhouettes.silhouette_curve(p.withColumns({f"k{k}": F.pmod("label", F.lit(k)) for k in (2, 3, 5, 7)}), {k: f"k{k}" for k in (2, 3, 5, 7)})
    return out.withColumn("silhouette", F.round("silhouette", 7))


@query(
    """WITH m AS (SELECT vec_id AS id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS v FROM embeddings), s AS (SELECT id, v, list_sum(v) AS t FROM m)
SELECT id, round(list_max(v), 6) AS spectral_radius, round(-list_sum(list_transform(v, lambda x: (x / t) * ln(x / t + 1e-10))), 6) AS dynamic_complexity FROM s"""
)
def dynamic_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("m")
    rows = points(spark, sf_dir).select("id", F.transform("features", lambda x: F.abs(x)).alias("m"))
    return rows.select("id", F.round(features.spectral_radius(m), 6).alias("spectral_radius"), F.round(features.dynamic_complexity(m), 6).alias("dynamic_complexity"))


#: Deviations from the mean vector, as rows.
V_SQL = """l AS (SELECT vec_id AS id, unnest(range(64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), c AS (SELECT id, d, x - avg(x) OVER (PARTITION BY d) AS x FROM l)"""


@query(f"WITH {V_SQL} SELECT id, round(sqrt(sum(x * x)), 5) AS norm FROM c GROUP BY id")
def pca_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all components the scores keep the length of a vector's deviation from the mean, whatever their signs."""
    out, _, _ = cluster.pca(points(spark, sf_dir), 64)
    return out.select("id", F.round(F.sqrt(F.aggregate("pcs", F.lit(0.0), lambda t, x: t + x * x)), 5).alias("norm"))


@query(
    f"""WITH {V_SQL}, co AS (SELECT a.d AS i, b.d AS j, sum(a.x * b.x) AS s FROM c a JOIN c b USING (id) GROUP BY ALL)
SELECT 64::BIGINT AS n, round(1, 6)::DOUBLE AS total, round(sum(s * s) / pow(sum(s) FILTER (i = j), 2), 6) AS squares FROM co"""
)
def explained_variance_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of all components sum to 1; their squares to those of the covariances over the squared total variance."""
    _, _, variance = cluster.pca(points(spark, sf_dir), 64)
    return variance.agg(F.count(F.lit(1)).alias("n"), F.round(F.max("cumulative"), 6).alias("total"), F.round(F.sum(F.col("ratio") * F.col("ratio")), 6).alias("squares"))


@query(None)
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _, _ = cluster.pca(points(spark, sf_dir), 10)
    return out.select("id", "label", "pcs")


@query(None)
def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = cluster.kmeans(similarity.l2_normalize(points(spark, sf_dir), "features"), 10)
    return out.select("id", "cluster")


@query(None)
def affinity_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = similarity.mean_vectors(points(spark, sf_dir), "label", "features", 10).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("features"))
    return cluster.affinity_propagation(means.withColumnRenamed("label", "id"))


@query(None)
def ar_eigen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four vectors in order of id are a label's matrix: 4 * 3 lags and the bias are their first 13 components.

    All rows are used; only a group that lacks one of its four ids, as the last may, is left out.
    """
    n = 4
    rows = points(spark, sf_dir, n * 3 + 1).select(F.floor(F.col("id") / n).cast("int").alias("label"), F.pmod(F.col("id"), F.lit(n)).cast("int").alias("row"), F.col("features").alias("values"))
    whole = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("label"))).where(F.col("_n") == n).drop("_n")
    return features.dynamics_features(whole)


@query(
    """WITH v AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), d AS (SELECT *, a * a + 4 * b AS disc FROM v),
m AS (SELECT id, [abs(a + sqrt(a * a + 4)) / 2, abs(a - sqrt(a * a + 4)) / 2] AS h, CASE WHEN disc >= 0 THEN [abs(a + sqrt(greatest(disc, 0))) / 2, abs(a - sqrt(greatest(disc, 0))) / 2] ELSE [sqrt(abs(b)), sqrt(abs(b))] END AS e FROM d)
SELECT id, round(list_max(h), 6) AS eigh_1, round(list_min(h), 6) AS eigh_2, round(list_max(e), 6) AS eig_1, round(list_min(e), 6) AS eig_2 FROM m"""
)
def ar_eigen_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's first two components as the lags of one variable and its third as the bias; SQL has the closed form of both solvers."""
    rows = features.drop_bias(points(spark, sf_dir, 3).select("id", F.lit(0).alias("row"), F.col("features").alias("values")))
    found = []
    for mode in ("eigh", "eig"):
        e = features.ar_eigenvalues(rows, label="id", lags=2, mode=mode)
        found.append(e.select("id", *(F.round(c, 6).alias(f"{mode}_{i + 1}") for i, c in enumerate(features.first_magnitudes(F.col("magnitudes"), 2)))))
    return found[0].join(found[1], "id")


@query(_lloyd_sql(1).replace("SELECT id, cluster, round(", "SELECT id, CASE WHEN id % 5 = 0 THEN 'new' ELSE 'old' END AS origin, cluster, round("))
def warm_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One warm iteration over old and new points, told apart again."""
    p = points(spark, sf_dir)
    out, _ = cluster.update_centroids(p.where("id % 5 <> 0"), p.where("id % 5 = 0"), _centroids(spark, sf_dir), max_iter=1)
    return out.select("id", "origin", F.col("cluster").cast("long").alias("cluster"), F.round("distance", 6).alias("distance"))


@query(None)
def cluster_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    old, new = p.where("id % 5 <> 0"), p.where("id % 5 = 0")
    flagged = cluster.flag_new(cluster.assign(new, _centroids(spark, sf_dir)), threshold=1.1)
    out, _ = cluster.add_clusters(old, flagged, _centroids(spark, sf_dir))
    return out.select("id", "origin", "cluster", F.round("distance", 6).alias("distance"))
