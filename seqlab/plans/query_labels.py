"""Queries over ``lineitem`` as label resamples: a frame per order, a resample per line, the supplier's last digit as label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlab.operators import normalize, resample, similarity, usage
from seqlab.plans.register import query, table
from seqlab.sources import tables

FRAME, RESAMPLE = ["frame"], ["resample", "tie", "place"]


def resamples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, resample with a tie-breaker, label, flipped (the label seen from the other side), session."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("resample"), F.col("l_suppkey").alias("tie"), F.col("l_partkey").alias("place"),
        (F.col("l_suppkey") % 10).cast("int").alias("label"), (F.col("l_partkey") % 10).cast("int").alias("flipped"), (F.col("l_orderkey") % 50).alias("uuid"),
    )


R_SQL = """
x AS (SELECT l_orderkey AS frame, l_linenumber AS resample, l_suppkey AS tie, l_partkey AS place, CAST(l_suppkey % 10 AS INTEGER) AS label, CAST(l_partkey % 10 AS INTEGER) AS flipped, l_orderkey % 50 AS uuid FROM lineitem)"""
E_SQL = (
    R_SQL
    + """,
c AS (SELECT frame, CAST(label <> lag(label) OVER (PARTITION BY frame ORDER BY resample, tie, place) AS INT) AS ch FROM x),
en AS (SELECT frame, CAST(coalesce(sum(ch), 0) AS BIGINT) AS n_changes, count(ch) AS n_steps FROM c GROUP BY frame),
en2 AS (SELECT *, CASE WHEN n_changes > 0 AND n_changes < n_steps THEN
  -((n_changes / n_steps) * ln(n_changes / n_steps) + (1 - n_changes / n_steps) * ln(1 - n_changes / n_steps)) ELSE 0.0 END AS entropy FROM en)"""
)
K_SQL = (
    R_SQL
    + """,
n AS (SELECT frame, label, count(*) AS n FROM x GROUP BY frame, label),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY frame ORDER BY n DESC, label DESC) AS INTEGER) AS rank FROM n),
tp AS (SELECT *, n / sum(n) OVER (PARTITION BY frame) AS share FROM rk WHERE rank <= 2),
oc AS (SELECT label, sum(share) AS occupancy FROM tp GROUP BY label),
fe AS (SELECT frame, -sum(share * log2(share)) AS entropy FROM tp GROUP BY frame),
ce AS (SELECT a.label AS i, b.label AS j, avg(fe.entropy) AS mean_entropy, count(*) AS n_frames FROM tp a JOIN tp b ON a.frame = b.frame AND a.label <> b.label JOIN fe ON fe.frame = a.frame GROUP BY ALL),
cc AS (SELECT ce.* FROM ce JOIN oc oi ON oi.label = ce.i JOIN oc oj ON oj.label = ce.j WHERE round(oj.occupancy, 9) >= round(oi.occupancy, 9)),
nb AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY round(mean_entropy, 9) DESC, j DESC) AS INTEGER) AS rank FROM cc WHERE mean_entropy > 0.5)"""
)


@query(f"WITH {R_SQL} SELECT count(DISTINCT frame) AS n_frames, count(*) AS n_rows FROM x WHERE frame IN (SELECT frame FROM x GROUP BY frame HAVING min(label) >= 1)")
def resample_valid_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resamples(spark, sf_dir).withColumn("label", F.col("label") - 1)  # label 0 plays the invalid one
    per = resample.valid_frames(rows, frame=FRAME).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_frames"), F.sum("n").alias("n_rows"))


@query(f"WITH {E_SQL} SELECT frame, n_changes, n_steps, round(entropy, 6) AS entropy FROM en2")
def resample_transition_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.transition_entropy(resamples(spark, sf_dir), frame=FRAME, resample=RESAMPLE)
    return out.select("frame", F.coalesce("n_changes", F.lit(0)).alias("n_changes"), "n_steps", F.round("entropy", 6).alias("entropy"))


@query(f"WITH {E_SQL} SELECT frame, frame % 50 AS uuid FROM (SELECT *, max(entropy) OVER (PARTITION BY frame % 50 ORDER BY frame ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS near FROM en2) WHERE near < 0.25")
def stable_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = resample.transition_entropy(resamples(spark, sf_dir), frame=["uuid", "frame"], resample=RESAMPLE)
    return resample.stable_frames(e).select("frame", "uuid")


@query(f"WITH {K_SQL} SELECT frame, label, n, rank, round(share, 6) AS share FROM tp")
def frame_topk_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.top_labels(resamples(spark, sf_dir), frame=FRAME).withColumn("share", F.round("share", 6))


@query(f"WITH {K_SQL} SELECT label, round(occupancy, 4) AS occupancy FROM oc")
def label_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.occupancy(resample.top_labels(resamples(spark, sf_dir), frame=FRAME)).withColumn("occupancy", F.round("occupancy", 4))


@query(f"WITH {K_SQL} SELECT i, j, rank, n_frames, round(mean_entropy, 6) AS mean_entropy FROM nb WHERE rank <= 2")
def conditional_entropy_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = resample.neighbours(resample.conditional_entropy(resample.top_labels(resamples(spark, sf_dir), frame=FRAME), frame=FRAME))
    return near.select("i", "j", "rank", "n_frames", F.round("mean_entropy", 6).alias("mean_entropy"))


C_SQL = """
mv AS (SELECT label, d, avg(x) AS x FROM (SELECT label, unnest(range(10)) AS d, CAST(unnest(list_slice(embedding, 1, 10)) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL),
nm AS (SELECT label, sqrt(sum(x * x)) AS norm FROM mv GROUP BY label),
cs AS (SELECT a.label AS i, b.label AS j, sum(a.x * b.x) / (any_value(na.norm) * any_value(nb2.norm)) AS similarity FROM mv a JOIN mv b ON a.d = b.d JOIN nm na ON na.label = a.label JOIN nm nb2 ON nb2.label = b.label GROUP BY a.label, b.label)"""


@query(
    f"""WITH {K_SQL}, {C_SQL}
SELECT i AS old, arg_min(j, rank) AS new, round(arg_min(similarity, rank), 6) AS similarity FROM (SELECT nb.*, similarity FROM nb JOIN cs USING (i, j) WHERE rank <= 2 AND similarity > 0) GROUP BY i"""
)
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = resample.neighbours(resample.conditional_entropy(resample.top_labels(resamples(spark, sf_dir), frame=FRAME), frame=FRAME))
    cosine = similarity.label_cosine(table(spark, sf_dir, "embeddings"), "label", "embedding", 10)
    return resample.merge_candidates(near, cosine).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {R_SQL} SELECT round(100 * avg(s), 6) AS agreement, count(*) AS n_sessions FROM (SELECT uuid, avg(CAST(label = flipped AS DOUBLE)) AS s FROM x GROUP BY uuid)")
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.agreement(resamples(spark, sf_dir)).withColumn("agreement", F.round("agreement", 6))


J_SQL = (
    R_SQL
    + """,
jn AS (SELECT label AS i, flipped AS j, count(*) AS n FROM x GROUP BY ALL),
jc AS (SELECT i, j, n, sum(n) OVER (PARTITION BY i) + sum(n) OVER (PARTITION BY j) - n AS n_union FROM jn)"""
)


@query(f"WITH {J_SQL} SELECT i, j, n, CAST(n_union AS BIGINT) AS n_union, round(n / n_union, 6) AS jaccard FROM jc")
def label_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.label_jaccard(resamples(spark, sf_dir)).withColumn("jaccard", F.round("jaccard", 6))


@query(f"WITH {J_SQL} SELECT i, j, n FROM jc WHERE i < j AND 20 * n > n_union ORDER BY n_union / n, i DESC, j DESC")
def similar_label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.similar_pairs(similarity.label_jaccard(resamples(spark, sf_dir)), 0.05)
    return found.orderBy(F.desc("jaccard"), F.desc("i"), F.desc("j")).select("i", "j", "n")


@query(
    f"""WITH {J_SQL}, us AS (SELECT label, count(*) / sum(count(*)) OVER () AS usage FROM x GROUP BY label),
p AS (SELECT jc.i, jc.j, ui.usage AS a, uj.usage AS b FROM jc JOIN us ui ON ui.label = jc.i JOIN us uj ON uj.label = jc.j WHERE jc.i < jc.j)
SELECT i AS syll_i, j AS syll_j, CASE WHEN a > b THEN i ELSE j END AS merge_into, CASE WHEN a > b THEN j ELSE i END AS to_merge FROM p"""
)
def merge_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resamples(spark, sf_dir)
    pairs = similarity.label_jaccard(rows).where("i < j").select(F.col("i").alias("syll_i"), F.col("j").alias("syll_j"))
    return usage.merge_directions(pairs, usage.label_usage(rows, onset=None)).select("syll_i", "syll_j", "merge_into", "to_merge")


@query(
    f"""WITH {R_SQL}, us AS (SELECT label, count(*) / sum(count(*)) OVER () AS usage FROM x GROUP BY label), m(old, new) AS (VALUES (1, 2), (2, 3), (4, 4))
SELECT old, new, printf('%d (%.3f) -> %d (%.3f)', old, a.usage, new, b.usage) AS line FROM m JOIN us a ON a.label = old JOIN us b ON b.label = new"""
)
def merge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    merges = spark.createDataFrame([(1, 2), (2, 3), (4, 4)], "old int, new int")
    return usage.merge_log(merges, usage.label_usage(resamples(spark, sf_dir), onset=None))


_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(f"WITH {J_SQL} SELECT i AS label, n, round(n / n_union, 6) AS jaccard, row_number() OVER (ORDER BY n / n_union DESC, i) AS rank FROM jc WHERE i = j")
def agreement_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagonal of the label matrix, best first; the window is over a row per label."""
    own = similarity.label_jaccard(resamples(spark, sf_dir)).where("i = j")
    rank = F.row_number().over(Window.orderBy(F.desc("jaccard"), "i"))
    return own.select(F.col("i").alias("label"), "n", F.round("jaccard", 6).alias("jaccard"), rank.cast("long").alias("rank"))


@query(f"WITH {J_SQL} SELECT i, " + ", ".join(f'round(coalesce(max(n / n_union) FILTER (j = {k}), 0), 6) AS "{k}"' for k in range(10)) + " FROM jc GROUP BY i")
def jaccard_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label matrix with a column per label; pairs that are never seen are 0."""
    jaccard = similarity.label_jaccard(resamples(spark, sf_dir)).withColumn("jaccard", F.round("jaccard", 6))
    return tables.dense_matrix(jaccard, list(range(10)), value="jaccard")


@query(f"WITH {J_SQL}, {C_SQL} SELECT i, j, round(similarity, 6) AS correlation, round(n / n_union, 6) AS confusion_rate FROM jc JOIN cs USING (i, j) WHERE i < j AND 20 * n > n_union AND similarity > 0")
def accepted_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of labels above both thresholds: confusion of the resamples, and likeness of their mean vectors."""
    pairs = similarity.similar_pairs(similarity.label_jaccard(resamples(spark, sf_dir)), 0.0).select("i", "j", F.col("jaccard").alias("confusion_rate"))
    alike = similarity.label_cosine(table(spark, sf_dir, "embeddings"), "label", "embedding", 10).withColumnRenamed("similarity", "correlation")
    found = similarity.accept_candidates(pairs.join(alike, ["i", "j"]), kinematic=0.0, confusion=0.05)
    return found.select("i", "j", F.round("correlation", 6).alias("correlation"), F.round("confusion_rate", 6).alias("confusion_rate"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for a in _COLUMNS for b in _COLUMNS))
def feature_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.correlations(table(spark, sf_dir, "lineitem"), _COLUMNS).withColumn("correlation", F.round("correlation", 6))
