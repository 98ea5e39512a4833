"""The operators' queries over the standard tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.llm import bpe, centroids, decontamination, licenses, line_dedup, near_dup, simhash, spelling, token_counts, token_files, topk, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token belongs to the line of its first byte."""
    out = token_counts.section_tokens(_table(spark, sf_dir, "documents"), rule="first")
    return out.withColumn("n_tokens", F.col("n_tokens").cast("long"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("item_ids")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", topk.quantized(F.col("embedding")).alias("weights"))
    return topk.top_k(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels"))).drop("matches")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), end_id=2).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(_table(spark, sf_dir, "pages"), with_payload=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("detections")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(_table(spark, sf_dir, "documents"), outputs=False, fixed_scan=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.document_variants(_table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_decontamination, op3_exact_topk, op4_toxicity, op5_ngram_jaccard_join, op6_token_files, op7_warc, op8_license_scan, op9_line_dedup, op10_bpe,
        op11_spelling_variants, op12_centroid_clustering, op13_simhash,
    )
}

_WORDS = r"list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

def _lloyd_sql(rounds: int = 10) -> str:
    """The rounds of op12, one after the other."""
    near = """
a{i} AS MATERIALIZED (SELECT v, arg_min(cluster, o) AS cluster, CAST(min(o[1]) AS BIGINT) AS distance FROM (
  SELECT v.v, c.cluster, [list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y), c.cluster] AS o FROM v, c{i} c) GROUP BY v),"""
    mean = """
m{i} AS (SELECT cluster, list(x ORDER BY dim) AS y FROM (
  SELECT cluster, dim, CAST(floor(CAST(sum(CAST(x[dim] AS HUGEINT)) AS DOUBLE) / count(*)) AS DOUBLE) AS x FROM a{p} JOIN v USING (v), range(1, 65) AS r(dim) GROUP BY ALL) GROUP BY cluster),
c{i} AS MATERIALIZED (SELECT c.cluster, coalesce(m.y, c.y) AS y FROM c{p} c LEFT JOIN m{i} m USING (cluster)),"""
    steps = near.format(i=0) + "".join(mean.format(i=i, p=i - 1) + near.format(i=i) for i in range(1, rounds + 1))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS v, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, vec_id, x) - 1 AS cluster, x AS y
           FROM (SELECT *, sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM v) ORDER BY h, vec_id, x LIMIT 8),{steps}
s AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY cluster),
h AS (SELECT cluster, sha256(array_to_string(list_transform(y, lambda t: CAST(CAST(t AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM c{rounds})
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, cluster_inertia, (SELECT CAST(sum(cluster_inertia) AS BIGINT) FROM s) AS inertia, centroid_sha256
FROM a{rounds} JOIN v USING (v) JOIN s USING (cluster) JOIN h USING (cluster)
"""


ORACLE_SQL: dict[str, str] = {
    "op11_spelling_variants": r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
runs AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS w FROM documents) GROUP BY ALL),
hashed AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)), '..'), lambda b: CAST('0x' || b AS BIGINT))),
           lambda c, b: xor(c >> 8, t.crc[1 + (xor(c, b) & 255)])), 4294967295) AS h FROM runs, t),
kept AS (SELECT CASE WHEN h % 31 = 0 THEN substring(w, 1, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gone AS MATERIALIZED (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n AS m FROM gone a JOIN gone b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM gone a JOIN words b ON a.d = b.word UNION SELECT b.word, a.word, a.n FROM gone a JOIN words b ON a.d = b.word),
best AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, near) = 1),
told AS MATERIALIZED (SELECT w.word, CASE WHEN m >= 10 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS stop, form AS onward FROM told UNION ALL SELECT walk.word, told.word, told.form FROM walk JOIN told ON told.word = walk.onward)
SELECT word, form, stop AS root, n, n_near, form_n FROM told JOIN (SELECT word, stop FROM walk WHERE onward IS NULL) USING (word)
""",
    "op12_centroid_clustering": _lloyd_sql(),
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, list_slice(w, s, s + 12) AS x FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(x) AS n FROM win),
dw AS (SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT dw.doc_id, dw.s, dw.n, win.item FROM dw JOIN win ON dw.x = win.x),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(pos.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
       sha256(coalesce(its.items, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AND 20 * coalesce(pos.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
""",
    "op3_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(CAST(q.w AS DOUBLE[]), CAST(v.w AS DOUBLE[])) AS BIGINT) AS score FROM q JOIN v ON q.vec_id <> v.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
k AS (SELECT payload_digest, payload_bytes, max(page_id) AS keeper FROM d WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper > page_id OR (page_id IS NULL AND keeper IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper > page_id OR page_id IS NULL THEN keeper END AS refers_to
FROM d LEFT JOIN k USING (payload_digest, payload_bytes)
""",
    "op9_line_dedup": r"""
WITH l AS (SELECT doc_id, pos, list_extract(lines, pos) AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.keeper IS NOT NULL AND c.keeper <> k.doc_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
}
