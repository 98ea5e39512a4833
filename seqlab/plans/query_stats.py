"""Queries over ``orders``, ``customer``, ``part`` and ``labels`` as usage statistics, treatments and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.operators import cluster, forests, normalize, plots, quantiles, similarity, treatments, usage
from seqlab.plans import registry
from seqlab.plans.register import query, table

LABELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stats table: a group per market segment, a subject per customer nation and segment, usage of order priorities."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select(F.col("c_mktsegment").alias("group"), F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("uuid"), F.col("o_orderpriority").alias("syllable"), "o_orderstatus")
    return rows


def _stats(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    out = usage.label_usage(stats(spark, sf_dir).where(where), label="syllable", onset=None, by=["group", "uuid"])
    return out.select("group", "uuid", "syllable", "usage")


S_SQL = """
b AS (SELECT c_mktsegment AS "group", c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR) AS uuid, o_orderpriority AS syllable, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey),
st AS (SELECT "group", uuid, syllable, count(*) / sum(count(*)) OVER (PARTITION BY "group", uuid) AS usage FROM b GROUP BY "group", uuid, syllable)"""


@query(f"WITH {S_SQL} SELECT \"group\", syllable, round(avg(usage), 6) AS usage FROM st WHERE usage > 0.15 GROUP BY ALL")
def usage_threshold_group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.group_mean_usage(_stats(spark, sf_dir), threshold=0.15).withColumn("usage", F.round("usage", 6))


@query(f"WITH {S_SQL} SELECT \"group\", " + ", ".join(f"round(coalesce(avg(usage) FILTER (syllable = '{x}'), 0.0), 6) AS u{x[0]}" for x in LABELS) + " FROM st WHERE usage > 0.15 GROUP BY \"group\"")
def usage_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = usage.usage_pivot(_stats(spark, sf_dir).where("usage > 0.15"), LABELS)
    return out.select("group", *(F.round(f"`{x}`", 6).alias(f"u{x[0]}") for x in LABELS))


G_SQL = """
ga AS (SELECT "group", syllable, avg(usage) AS usage FROM st WHERE usage > 0.005 GROUP BY ALL),
gn AS (SELECT "group", sqrt(sum(usage * usage)) AS norm FROM ga GROUP BY "group"),
gd AS (SELECT a."group" AS g1, b."group" AS g2, sum(a.usage * b.usage) AS dot FROM ga a JOIN ga b USING (syllable) GROUP BY ALL)"""


@query(f"WITH {S_SQL}, {G_SQL} SELECT x.\"group\" AS group1, y.\"group\" AS group2, round(abs(1 - coalesce(dot, 0) / (x.norm * y.norm)), 6) AS cosine_distance FROM gn x CROSS JOIN gn y LEFT JOIN gd ON g1 = x.\"group\" AND g2 = y.\"group\"")
def group_cosine_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = usage.group_mean_usage(_stats(spark, sf_dir))
    d = similarity.cosine_distances(means, means, keys_l=["group"], keys_r=["group"])
    return d.select(F.col("a_group").alias("group1"), F.col("b_group").alias("group2"), F.round(F.abs("cosine_distance"), 6).alias("cosine_distance"))


def _subject_sql(a: str, b: str) -> str:
    return f"""SELECT x."group" AS group1, y."group" AS group2, x.uuid, avg(1 - coalesce(dot, 0) / (x.norm * y.norm)) AS d FROM n{a} x CROSS JOIN n{b} y
LEFT JOIN (SELECT p.uuid AS u1, q.uuid AS u2, sum(p.usage * q.usage) AS dot FROM s{a} p JOIN s{b} q USING (syllable) GROUP BY ALL) ON u1 = x.uuid AND u2 = y.uuid GROUP BY x."group", y."group", x.uuid"""


@query(
    f"""WITH {S_SQL},
sa AS (SELECT "group", uuid, syllable, count(*) / sum(count(*)) OVER (PARTITION BY uuid) AS usage FROM b WHERE o_orderstatus = 'F' GROUP BY "group", uuid, syllable),
sb AS (SELECT "group", uuid, syllable, count(*) / sum(count(*)) OVER (PARTITION BY uuid) AS usage FROM b WHERE o_orderstatus <> 'F' GROUP BY "group", uuid, syllable),
na AS (SELECT "group", uuid, sqrt(sum(usage * usage)) AS norm FROM sa GROUP BY ALL), nb AS (SELECT "group", uuid, sqrt(sum(usage * usage)) AS norm FROM sb GROUP BY ALL)
SELECT group1, group2, uuid, round(abs(d), 6) AS cosine_distance FROM ({_subject_sql("a", "b")} UNION ALL {_subject_sql("b", "a")})"""
)
def subject_cosine_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _stats(spark, sf_dir, "o_orderstatus = 'F'"), _stats(spark, sf_dir, "o_orderstatus <> 'F'")
    return similarity.both_directions(a, b).withColumn("cosine_distance", F.round(F.abs("cosine_distance"), 6)).select("group1", "group2", "uuid", "cosine_distance")


@query(
    """WITH m AS (SELECT c_custkey % 1000 AS matcher, c_nationkey AS day, c_custkey AS session, NULL AS box, c_name || '.mp4' AS filename FROM customer WHERE c_custkey % 3 <> 0),
d AS (SELECT c_custkey % 1000 AS matcher, c_nationkey AS day, c_custkey AS session, NULL AS box, c_mktsegment AS treat FROM customer WHERE c_custkey % 4 <> 0)
SELECT coalesce(m.session, d.session) AS session, coalesce(m.day, d.day) AS day, replace(filename, '.mp4', '') AS filename_clean, treat FROM m FULL JOIN d ON m.matcher = d.matcher AND m.day = d.day AND m.session = d.session"""
)
def treatment_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    keys = [(F.col("c_custkey") % 1000).alias("matcher"), F.col("c_nationkey").alias("day"), F.col("c_custkey").alias("session"), F.lit(None).cast("string").alias("box")]
    file_map = c.where("c_custkey % 3 <> 0").select(*keys, F.concat("c_name", F.lit(".mp4")).alias("filename"))
    dosing = c.where("c_custkey % 4 <> 0").select(*keys, F.col("c_mktsegment").alias("treat"))
    return treatments.merge_schedules(file_map, dosing).select("session", "day", "filename_clean", "treat")


@query(
    """WITH f AS (SELECT '/data/' || c_name || '.h5' AS path, 'g' || CAST(c_nationkey % 3 AS VARCHAR) AS g, c_name, c_custkey, c_mktsegment FROM customer)
SELECT path, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment ELSE g END AS "group", c_custkey % 4 <> 0 AS changed FROM f"""
)
def treatment_group_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    files = c.select(F.concat(F.lit("/data/"), "c_name", F.lit(".h5")).alias("path"), F.concat(F.lit("g"), (F.col("c_nationkey") % 3).cast("string")).alias("group"))
    merged = c.where("c_custkey % 4 <> 0").select(F.col("c_name").alias("filename_clean"), F.col("c_mktsegment").alias("treat"))
    return treatments.update_groups(files, merged)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("experiment_name"), F.col("p_partkey").alias("syllable_id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))


P_SQL = "p AS (SELECT p_brand AS experiment_name, p_partkey AS syllable_id, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part)"
M_SQL = (
    P_SQL
    + """,
md AS (SELECT experiment_name, median(size) AS ms, median(price) AS mp FROM p GROUP BY 1),
dv AS (SELECT p.*, ms, mp, abs(size - ms) AS ds, abs(price - mp) AS dp FROM p JOIN md USING (experiment_name))"""
)


@query(f"WITH {P_SQL}, s AS (SELECT experiment_name, avg(size) AS a, stddev_samp(size) AS b, avg(price) AS c, stddev_samp(price) AS d FROM p GROUP BY 1) SELECT experiment_name, syllable_id, round((size - a) / nullif(b, 0), 6) AS z_size, round((price - c) / nullif(d, 0), 6) AS z_price FROM p JOIN s USING (experiment_name)")
def zscore_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similarity.zscore(_features(spark, sf_dir), ["size", "price"], by=["experiment_name"])
    return out.select("experiment_name", "syllable_id", F.round("z_size", 6).alias("z_size"), F.round("z_price", 6).alias("z_price"))


@query(f"WITH {M_SQL}, m AS (SELECT experiment_name, median(ds) AS s, median(dp) AS q FROM dv GROUP BY 1) SELECT experiment_name, syllable_id, round((size - ms) / nullif(1.4826::DOUBLE * s, 0), 6) AS z_size, round((price - mp) / nullif(1.4826::DOUBLE * q, 0), 6) AS z_price FROM dv JOIN m USING (experiment_name)")
def robust_zscore_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalize.robust_zscore(_features(spark, sf_dir), ["size", "price"])
    return out.select("experiment_name", "syllable_id", F.round("z_size", 6).alias("z_size"), F.round("z_price", 6).alias("z_price"))


@query(f"WITH {M_SQL}, m AS (SELECT experiment_name, median(d) AS s FROM (SELECT experiment_name, ds AS d FROM dv UNION ALL SELECT experiment_name, dp FROM dv) GROUP BY 1) SELECT experiment_name, syllable_id, round((size - ms) / nullif(1.4826::DOUBLE * s, 0), 6) AS z_size, round((price - mp) / nullif(1.4826::DOUBLE * s, 0), 6) AS z_price FROM dv JOIN m USING (experiment_name)")
def robust_zscore_global_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalize.robust_zscore(_features(spark, sf_dir), ["size", "price"], mad_scope="global")
    return out.select("experiment_name", "syllable_id", F.round("z_size", 6).alias("z_size"), F.round("z_price", 6).alias("z_price"))


@query("SELECT l_returnflag, c AS column_name, median(x) AS median, count(x) AS n FROM (SELECT l_returnflag, unnest(['quantity', 'price']) AS c, unnest([CAST(l_quantity AS DOUBLE), CAST(l_extendedprice AS DOUBLE)]) AS x FROM lineitem) GROUP BY ALL")
def group_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians of large groups (A22), by counting."""
    values = F.array(*(F.struct(F.lit(n).alias("column_name"), F.col(c).cast("double").alias("x")) for n, c in (("quantity", "l_quantity"), ("price", "l_extendedprice"))))
    long = table(spark, sf_dir, "lineitem").select("l_returnflag", F.inline(values))
    return quantiles.exact_medians(long, ["l_returnflag", "column_name"], "x")


@query("SELECT l_returnflag, count(x) AS n, min(x) AS low, round(q[1], 6) AS q1, round(q[2], 6) AS median, round(q[3], 6) AS q3, max(x) AS high FROM (SELECT l_returnflag, CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem) JOIN (SELECT l_returnflag, quantile_cont(CAST(l_extendedprice AS DOUBLE), [0.25, 0.5, 0.75]) AS q FROM lineitem GROUP BY 1) USING (l_returnflag) GROUP BY l_returnflag, q")
def box_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of large groups, by counting."""
    out = plots.box_quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", "n", "low", *(F.round(c, 6).alias(c) for c in ("q1", "median", "q3")), "high")


@query("""WITH e AS (SELECT min(l_quantity)::DOUBLE AS lo, max(l_quantity)::DOUBLE AS hi FROM lineitem),
b AS (SELECT l_returnflag, CAST(least(floor((l_quantity::DOUBLE - lo) / ((hi - lo) / 10)), 9) AS BIGINT) AS bin, lo, (hi - lo) / 10 AS w FROM lineitem, e)
SELECT l_returnflag, bin, round(lo + bin * w, 6) AS start, count(*) AS n FROM b GROUP BY ALL""")
def quantity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("x"))
    return plots.histogram(rows, "x", bins=10, by=["l_returnflag"]).withColumn("start", F.round("start", 6))


@query("WITH s AS (SELECT l_returnflag, avg(l_quantity) AS m, 1.96 * stddev_samp(l_quantity) / sqrt(count(l_quantity)) AS h, count(l_quantity) AS n FROM lineitem GROUP BY 1) SELECT l_returnflag, n, round(m, 6) AS mean, round(m - h, 6) AS low, round(m + h, 6) AS high FROM s")
def normal_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plots.mean_with_error(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"])
    return out.select("l_returnflag", "n", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


_POISSON_SQL = " + ".join(f"CAST(t >= {cut} AS INT)" for cut in plots.POISSON)


@query(
    f"""WITH d AS (SELECT l_returnflag, l_quantity, l_discount, r, (l_orderkey * 8 + l_linenumber) % {plots.PRIME} AS k FROM lineitem, range(0, 101) AS x(r)),
a AS (SELECT *, (k * 48271 + r * 69621 + 11) % {plots.PRIME} AS t FROM d), b AS (SELECT * REPLACE ((t * t + r * 16807 + 7) % {plots.PRIME} AS t) FROM a), c AS (SELECT * REPLACE ((t * (t + 30269)) % {plots.PRIME} AS t) FROM b),
w AS (SELECT l_returnflag, r, unnest(['quantity', 'discount']) AS metric, unnest([CAST(l_quantity AS DOUBLE), CAST(round(100 * l_discount) AS DOUBLE)]) AS x, CASE WHEN r = 0 THEN 1 ELSE {_POISSON_SQL} END AS w FROM c),
m AS (SELECT l_returnflag, metric, r, CAST(sum(w) AS BIGINT) AS n, sum(x * w) / sum(w) AS m FROM w GROUP BY ALL)
SELECT l_returnflag, metric, max(n) FILTER (r = 0) AS n, round(max(m) FILTER (r = 0), 6) AS mean, round(quantile_cont(m, 0.025) FILTER (r > 0), 6) AS low, round(quantile_cont(m, 0.975) FILTER (r > 0), 6) AS high FROM m GROUP BY ALL"""
)
def bootstrap_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of 100 Poisson replicates, whose weights SQL computes too."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), F.col("l_quantity").alias("quantity"), F.round(100 * F.col("l_discount")).alias("discount"))
    out = plots.bootstrap_bands(rows, ["quantity", "discount"], ["l_returnflag"], key="k", replicates=100)
    return out.select("l_returnflag", "metric", "n", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


@query("SELECT coalesce(a.k, b.k) AS uuid, a.k IS NOT NULL AS in_a, b.k IS NOT NULL AS in_b FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def session_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders against customers in credit, as two sets of sessions."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uuid"))
    return similarity.session_differences(orders, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("uuid")))


@query("SELECT 'size' AS column_name, CAST(count(*) FILTER (p_size % 7 = 0) AS BIGINT) AS n_missing, count(*) AS n_rows FROM part UNION ALL SELECT 'price', 0, count(*) FROM part")
def dropna_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _features(spark, sf_dir).withColumn("size", F.when(F.col("size") % 7 != 0, F.col("size")))
    return normalize.missing_counts(rows, ["size", "price"])


@query("SELECT o_orderstatus AS experiment_name, count(*) AS n, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS n_extra FROM orders GROUP BY o_orderstatus")
def union_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    tables = {s: o.where(F.col("o_orderstatus") == s).select("o_orderkey", *([F.lit(1).alias("extra")] if s == "F" else [])) for s in ("F", "O", "P")}
    out = normalize.union_experiments(tables)
    return out.groupBy("experiment_name").agg(F.count(F.lit(1)).alias("n"), F.count("extra").alias("n_extra"))


def _classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents' languages as ground truth, a number of their source as cluster."""
    d = table(spark, sf_dir, "documents")
    truth = d.select("doc_id", F.col("lang").alias("ground_truth_label"))
    assigned = table(spark, sf_dir, "labels").join(d.select("doc_id", "source"), "doc_id").select("doc_id", F.col("source").alias("cluster"))
    return assigned, truth


L_SQL = "a AS (SELECT doc_id, source AS cluster, lang AS ground_truth_label FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {L_SQL} SELECT ground_truth_label, cluster, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_size FROM a GROUP BY ground_truth_label, cluster")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, truth = _classes(spark, sf_dir)
    return cluster.contingency(assigned, truth, on=["doc_id"])


@query(f"WITH {L_SQL} SELECT cluster, count(*) AS n, count(DISTINCT ground_truth_label) AS n_labels, round(count(*) / count(DISTINCT ground_truth_label), 6) AS uniqueness FROM a GROUP BY cluster HAVING count(*) > 1 ORDER BY count(*) / count(DISTINCT ground_truth_label) DESC, cluster LIMIT 5")
def cluster_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, truth = _classes(spark, sf_dir)
    return cluster.cluster_uniqueness(assigned.join(truth, "doc_id")).withColumn("uniqueness", F.round("uniqueness", 6))


@query("SELECT CAST(count(*) FILTER (quality <> 0) AS BIGINT) AS n_kept, CAST(count(*) FILTER (quality = 0) AS BIGINT) AS n_rejected FROM labels")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").withColumn("syllable_quality", F.when(F.col("quality") == 0, "Low").otherwise("High"))
    kept, rejected = cluster.split_quality(rows)
    return kept.agg(F.count(F.lit(1)).alias("n_kept")).join(rejected.agg(F.count(F.lit(1)).alias("n_rejected")))


@query(
    """WITH v AS (SELECT 'v' || CAST(r_regionkey + 1 AS VARCHAR) || '.' || CAST(n_nationkey % 12 AS VARCHAR) AS version, n_nationkey = 0 AS is_original, r_regionkey + 1 AS major, n_nationkey % 12 AS minor FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT version, is_original, CASE WHEN is_original THEN 'Original' WHEN row_number() OVER (PARTITION BY is_original ORDER BY major DESC, minor DESC) <= 3 THEN 'Preserved' ELSE 'Archived' END AS status FROM v"""
)
def version_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    v = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.format_string("v%d.%d", (F.col("r_regionkey") + 1).cast("int"), (F.col("n_nationkey") % 12).cast("int")).alias("version"), (F.col("n_nationkey") == 0).alias("is_original"))
    return registry.retention(v)


#: A small forest over the scaled size and price of a part: (tree, node, feature, threshold, left, right, weight, votes of three classes).
SMALL_FOREST = (
    (0, 0, 0, 0.0, 1, 2, 1.0, (1.0, 1.0, 1.0)), (0, 1, 1, -0.5, 3, 4, 1.0, (1.0, 1.0, 1.0)), (0, 2, -1, 0.0, -1, -1, 1.0, (1.0, 2.0, 7.0)), (0, 3, -1, 0.0, -1, -1, 1.0, (6.0, 2.0, 2.0)), (0, 4, -1, 0.0, -1, -1, 1.0, (1.0, 3.0, 0.0)),
    (1, 0, 1, 0.25, 1, 2, 2.0, (1.0, 1.0, 1.0)), (1, 1, -1, 0.0, -1, -1, 2.0, (3.0, 1.0, 0.0)), (1, 2, -1, 0.0, -1, -1, 2.0, (0.0, 1.0, 1.0)),
)


@query(
    """WITH x AS (SELECT p_partkey, (p_size - 25) / 10.0::DOUBLE AS a, (p_retailprice - 1200) / 400.0::DOUBLE AS b FROM part),
v AS (SELECT p_partkey, CASE WHEN a <= 0 THEN CASE WHEN b <= -0.5 THEN [0.6, 0.2, 0.2] ELSE [0.25, 0.75, 0.0] END ELSE [0.1, 0.2, 0.7] END AS s, CASE WHEN b <= 0.25 THEN [1.5, 0.5, 0.0] ELSE [0.0, 1.0, 1.0] END AS t FROM x),
w AS (SELECT p_partkey, unnest([0, 1, 2]) AS c, unnest(list_transform(range(1, 4), lambda i: CAST(s[i] AS DOUBLE) + CAST(t[i] AS DOUBLE))) AS v FROM v)
SELECT p_partkey, CAST(arg_max(c, struct_pack(v := round(v, 9), c := -c)) AS DOUBLE) AS prediction, round(max(v) / 3, 6) AS probability FROM w GROUP BY p_partkey"""
)
def forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts classified by a bundle of tables."""
    bundle = forests.TreeBundle(spark.createDataFrame([(0, "p_size", 25.0, 10.0), (1, "p_retailprice", 1200.0, 400.0)], forests.INPUTS), spark.createDataFrame([(*r[:7], list(r[7])) for r in SMALL_FOREST], forests.NODES))
    out = bundle.transform(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"))
    return out.select("p_partkey", "prediction", F.round(F.array_max("probability"), 6).alias("probability"))


@query("SELECT p_partkey AS syllable_id, p_size % 7 AS library_label, CASE WHEN p_partkey % 3 = 0 THEN p_size > 40 END AS cluster_candidate, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'old' END AS experiment_name FROM part")
def library_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New labels appended to a library that has no cluster_candidate yet."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("syllable_id"), (F.col("p_size") % 7).alias("library_label"), (F.col("p_size") > 40).alias("cluster_candidate"))
    old, new = rows.where("syllable_id % 3 <> 0").drop("cluster_candidate"), rows.where("syllable_id % 3 = 0")
    return normalize.union_experiments({"old": old, "new": new})


@query(
    """WITH v AS (SELECT o_custkey AS library, o_orderkey % 5 <> 0 AS ok, o_orderkey % 11 AS major, o_orderkey % 23 AS minor FROM orders),
n AS (SELECT library, max(struct_pack(a := major, b := minor)) FILTER (ok) AS m FROM v GROUP BY library)
SELECT library, CASE WHEN m IS NULL THEN 'v1.0' ELSE 'v' || CAST(m.a + 1 AS VARCHAR) || '.0' END AS generated, CASE WHEN m IS NULL THEN 'v1.0' ELSE 'v' || CAST(m.a AS VARCHAR) || '.' || CAST(m.b + 1 AS VARCHAR) END AS added FROM n"""
)
def version_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: each customer's orders as versions of a library, every fifth a name that does not parse."""
    major, minor = ((F.col("o_orderkey") % m).cast("string") for m in (11, 23))
    name = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("draft"), major)).otherwise(F.concat(F.lit("v"), major, F.lit("."), minor))
    return registry.successors(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("library"), name.alias("version")), by=["library"])


@query(
    """WITH c AS (SELECT l_suppkey AS library, l_orderkey * 8 + l_linenumber AS seq, CASE l_partkey % 4 WHEN 0 THEN 'archive' WHEN 1 THEN 'restore' ELSE 'save' END AS action, 'v1.' || CAST(l_partkey % 9 AS VARCHAR) AS version FROM lineitem)
SELECT library, version, count(*) AS n_commits, arg_max(action, seq) = 'archive' AS archived FROM c GROUP BY ALL HAVING count(*) FILTER (action = 'save') > 0"""
)
def library_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's order lines as commits of a library, and the state that they lead to."""
    at = F.col("l_partkey") % 4
    action = F.when(at == 0, registry.ARCHIVE).when(at == 1, registry.RESTORE).otherwise(registry.SAVE)
    commits = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("library"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), action.alias("action"), F.concat(F.lit("v1."), (F.col("l_partkey") % 9).cast("string")).alias("version"))
    return registry.replay(commits, by=["library"])


@query(
    f"""WITH {P_SQL}, g AS (SELECT experiment_name, syllable_id, CASE WHEN syllable_id % 7 <> 0 THEN size END AS size, price FROM p),
f AS (SELECT *, 'dropna_first' AS mode FROM g WHERE size IS NOT NULL UNION ALL SELECT *, 'normalize_first' FROM g),
s AS (SELECT mode, experiment_name, avg(size) AS a, stddev_samp(size) AS b, avg(price) AS c, stddev_samp(price) AS d FROM f GROUP BY ALL)
SELECT mode, experiment_name, syllable_id, round((size - a) / b, 6) AS size, round((price - c) / d, 6) AS price FROM f JOIN s USING (mode, experiment_name) WHERE b > 0 AND d > 0 AND size IS NOT NULL"""
)
def preprocess_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both orders of V12: sizes of every seventh part are NaN, and a size or a price that does not vary is missing."""
    rows = _features(spark, sf_dir).withColumn("size", F.when(F.col("syllable_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("size")))
    both = [
        normalize.drop_missing(normalize.preprocess(rows, ["size", "price"], method="zscore", order=mode), ["size", "price"]).select(
            F.lit(mode).alias("mode"), "experiment_name", "syllable_id", F.round("size", 6).alias("size"), F.round("price", 6).alias("price")
        )
        for mode in ("dropna_first", "normalize_first")
    ]
    return both[0].unionByName(both[1])
