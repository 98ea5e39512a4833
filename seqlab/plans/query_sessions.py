"""Queries over ``events`` as a frame table: a session per user, frames in time order, the event type as label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlab.functions import text as X
from seqlab.operators import features, intervals, long_intervals, long_sessions, sequence, similarity, treatments, usage
from seqlab.plans.register import query, table
from seqlab.sources import session_store

#: The events' steps are hours, not video frames: one frame per second.
FPS = 1.0


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uuid, frame_seq (from 0), label, value, ts_ms."""
    e = table(spark, sf_dir, "events")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("uuid"), (F.row_number().over(order) - 1).cast("long").alias("frame_seq"), F.col("event_type").alias("label"), "value", (us / 1000.0).alias("ts_ms"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.number_runs(sequence.mark_onsets(frames(spark, sf_dir)))


F_SQL = """
f AS (SELECT user_id AS uuid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_seq, event_type AS label, value, epoch_us(ts) / 1000.0 AS ts_ms FROM events)"""
O_SQL = (
    F_SQL
    + """,
o AS (SELECT *, label IS DISTINCT FROM lag(label) OVER (PARTITION BY uuid ORDER BY frame_seq) AS onset FROM f),
r AS (SELECT *, CAST(sum(CAST(onset AS INTEGER)) OVER (PARTITION BY uuid ORDER BY frame_seq) AS BIGINT) AS run_id FROM o)"""
)
D_SQL = (
    O_SQL
    + """,
ons AS (SELECT uuid, run_id, frame_seq AS fs, lead(frame_seq) OVER w - frame_seq AS fwd, frame_seq - lag(frame_seq, 1, 0) OVER w AS bwd FROM r WHERE onset WINDOW w AS (PARTITION BY uuid ORDER BY frame_seq)),
dur AS (SELECT uuid, run_id, coalesce(fwd, lag(fwd) OVER (PARTITION BY uuid ORDER BY fs)) AS fwd, bwd FROM ons)"""
)


@query(f"WITH {F_SQL} SELECT uuid, frame_seq, label, value FROM (SELECT *, ts_ms - min(ts_ms) OVER (PARTITION BY uuid) AS since FROM f) WHERE since BETWEEN 1440 * 60000 AND 14400 * 60000")
def slice_session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequence.slice_session(frames(spark, sf_dir), start_min=1440, end_min=14400, keys=("uuid",))
    return out.select("uuid", "frame_seq", "label", "value")


@query(f"WITH {O_SQL} SELECT uuid, run_id, any_value(label) AS label, min(frame_seq) AS start, count(*) AS n FROM r GROUP BY uuid, run_id")
def label_run_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("uuid", "run_id").agg(F.first("label").alias("label"), F.min("frame_seq").alias("start"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {D_SQL} SELECT r.uuid, r.frame_seq, r.run_id, dur.fwd AS run_frames FROM r JOIN dur USING (uuid, run_id)")
def long_session_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and durations without a task per session: windows over chunks of 16 frames."""
    marked = long_sessions.mark_onsets(frames(spark, sf_dir), chunk=16)
    out = long_sessions.run_durations(long_sessions.number_runs(marked, chunk=16), chunk=16)
    return out.select("uuid", "frame_seq", "run_id", "run_frames")


@query(f"WITH {O_SQL} SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS usage FROM r WHERE onset GROUP BY label")
def label_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = usage.label_usage(sequence.mark_onsets(frames(spark, sf_dir)))
    return out.select("label", "n", F.round("usage", 6).alias("usage"))


@query(f"WITH {O_SQL} SELECT label, label || ': ' || CAST(count(*) AS VARCHAR) || '.000' AS line FROM r WHERE onset GROUP BY label")
def label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of the usage report for each label: its onsets, with three decimals."""
    out = usage.label_usage(sequence.mark_onsets(frames(spark, sf_dir)))
    return out.select("label", X.key_value_line(F.col("label"), F.col("n")).alias("line"))


@query(f"WITH {D_SQL} SELECT r.uuid, r.frame_seq, dur.fwd AS run_frames FROM r JOIN dur USING (uuid, run_id)")
def run_duration_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.run_durations(sequence.mark_onsets(frames(spark, sf_dir))).select("uuid", "frame_seq", "run_frames")


@query(f"WITH {D_SQL} SELECT r.uuid, r.frame_seq, dur.bwd AS run_frames FROM r JOIN dur USING (uuid, run_id)")
def run_duration_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.run_durations(sequence.mark_onsets(frames(spark, sf_dir)), mode="backward").select("uuid", "frame_seq", "run_frames")


@query(f"WITH {F_SQL} SELECT median(step) AS median_ms, 1000.0 / median(step) AS fps FROM (SELECT ts_ms - lag(ts_ms) OVER (PARTITION BY uuid ORDER BY frame_seq) AS step FROM f)")
def sampling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.sampling_rate(frames(spark, sf_dir))


@query(f"WITH {O_SQL} SELECT uuid, frame_seq, frame_seq - min(frame_seq) OVER (PARTITION BY uuid, run_id) AS \"offset\" FROM r")
def onset_aligned_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.align_to_onset(runs(spark, sf_dir)).select("uuid", "frame_seq", "offset")


@query(
    f"""WITH {O_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY uuid, run_id ORDER BY frame_seq) AS k FROM r)
SELECT uuid, frame_seq, round(value - avg(CASE WHEN k <= 2 THEN value END) OVER (PARTITION BY uuid, run_id), 6) AS aligned FROM n"""
)
def onset_aligned_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.align_to_onset(runs(spark, sf_dir), value="value").select("uuid", "frame_seq", F.round("aligned", 6).alias("aligned"))


T_SQL = O_SQL + """,
a AS (SELECT *, frame_seq - min(frame_seq) OVER (PARTITION BY uuid, run_id) AS k FROM r),
t AS (SELECT label, k AS "offset", avg(value) AS value, avg(sqrt(value)) AS root, count(*) AS n FROM a WHERE k <= 3 GROUP BY label, k)"""


def _trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = sequence.align_to_onset(runs(spark, sf_dir)).withColumn("root", F.sqrt("value"))
    return sequence.mean_trajectories(aligned, ["value", "root"], fps=FPS, horizon_s=3.0)


@query(f"WITH {T_SQL} SELECT label, \"offset\", round(value, 9) AS value, round(root, 9) AS root, n FROM t")
def trajectory_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trajectories(spark, sf_dir).select("label", "offset", F.round("value", 9).alias("value"), F.round("root", 9).alias("root"), "n")


@query(
    f"""WITH {T_SQL}, l AS (SELECT label, "offset", 'value' AS m, value AS x FROM t UNION ALL SELECT label, "offset", 'root', root FROM t),
d AS (SELECT label, m, x - min(x) OVER (PARTITION BY label, m) AS x, row_number() OVER (PARTITION BY label, m ORDER BY "offset") AS at, count(*) OVER (PARTITION BY label, m) AS len FROM l)
SELECT a.label AS i, b.label AS j, round(corr(a.x, CASE WHEN a.m = 'root' THEN -b.x ELSE b.x END), 6) AS correlation
FROM d a JOIN d b ON a.m = b.m AND a.at = b.at AND a.len = b.len WHERE a.label < b.label GROUP BY a.label, b.label"""
)
def trajectory_detrend_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _trajectories(spark, sf_dir)
    labels = t.select("label").distinct()
    pairs = labels.select(F.col("label").alias("i")).join(labels.select(F.col("label").alias("j")), F.col("i") < F.col("j"))
    out = similarity.trajectory_correlation(t, ["value", "root"], pairs, flip="root")
    return out.select("i", "j", F.round("correlation", 6).alias("correlation"))


#: Values are cents: their mean is summed as such and rounded half up, so that no order of sums decides a tie.
MEAN_SQL = "CAST((sum(CAST(round(value * 100) AS BIGINT)) * 20000 + count(*)) // (2 * count(*)) AS DOUBLE) / 1000000"


def exact(value: Column) -> Column:
    """Cents as decimals, whose means Spark rounds half up at six digits."""
    return value.cast("decimal(18,2)")


@query(
    f"""WITH {D_SQL}, x AS (SELECT r.label, r.value, dur.fwd / 1.0 AS s FROM r JOIN dur USING (uuid, run_id) WHERE r.onset)
SELECT label, count(*) AS n_onsets, {MEAN_SQL} AS avg_value, round(stddev_samp(value), 6) AS std_value, round(avg(s), 6) AS avg_duration_s, round(stddev_samp(s), 6) AS std_duration_s,
round(count(*) / sum(count(*)) OVER (), 6) AS normalized_frequency FROM x GROUP BY label"""
)
def label_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    onsets = sequence.run_durations(sequence.mark_onsets(frames(spark, sf_dir))).where("onset")
    out = features.label_features(onsets.withColumn("value", exact(F.col("value"))), ["value"], fps=FPS)
    return out.select("label", "n_onsets", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("avg_value", "std_value", "avg_duration_s", "std_duration_s", "normalized_frequency")))


@query(
    f"""WITH {D_SQL} SELECT r.label, count(*) AS n FROM r JOIN dur USING (uuid, run_id) WHERE r.onset AND dur.fwd > 1 AND dur.fwd < 4 GROUP BY r.label"""
)
def duration_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    onsets = sequence.run_durations(sequence.mark_onsets(frames(spark, sf_dir))).where("onset")
    return sequence.duration_band(onsets, fps=FPS, low_s=1, high_s=4).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


#: signup -> click, click -> view: a chain, which one pass does not follow.
MERGES = [("signup", "click"), ("click", "view")]


@query(
    f"""WITH {F_SQL}, m AS (SELECT label, CASE label WHEN 'signup' THEN 'click' WHEN 'click' THEN 'view' ELSE label END AS new_label FROM f)
SELECT new_label, count(*) AS n, round(100 * avg(CAST(label = new_label AS DOUBLE)), 6) AS percent_equal FROM m GROUP BY new_label"""
)
def relabel_single_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = usage.relabel(frames(spark, sf_dir), spark.createDataFrame(MERGES, "old string, new string"))
    n = out.groupBy("new_label").agg(F.count(F.lit(1)).alias("n"))
    return n.join(usage.percent_equal(out, "label", "new_label", by=["new_label"]), "new_label").withColumn("percent_equal", F.round("percent_equal", 6))


@query(
    f"""WITH {O_SQL} SELECT uuid % 3 AS "group", uuid, label, count(*) AS n, {MEAN_SQL} AS avg_value, round(count(*) / sum(count(*)) OVER (PARTITION BY uuid), 6) AS usage
FROM r WHERE onset GROUP BY uuid, label"""
)
def group_usage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence.mark_onsets(frames(spark, sf_dir)).withColumn("group", F.col("uuid") % 3)
    out = usage.group_usage_stats(rows.withColumn("value", exact(F.col("value"))), ["value"])
    return out.select("group", "uuid", "label", "n", F.col("avg_value").cast("double").alias("avg_value"), F.round("usage", 6).alias("usage"))


#: A frame is empty if its value is under 25.
E_SQL = F_SQL + ", em AS (SELECT *, value < 25 AS empty FROM f)"
I_SQL = (
    E_SQL
    + """,
dl AS (SELECT uuid, frame_seq, max(CAST(empty AS INT)) OVER (PARTITION BY uuid ORDER BY frame_seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS d, count(*) OVER (PARTITION BY uuid) AS n FROM em),
ed AS (SELECT *, CAST(d = 1 AND lag(d, 1, 0) OVER (PARTITION BY uuid ORDER BY frame_seq) = 0 AS INT) AS edge FROM dl),
ru AS (SELECT *, sum(edge) OVER (PARTITION BY uuid ORDER BY frame_seq) AS k FROM ed),
iv AS (SELECT uuid, min(frame_seq) - 1 AS s, CASE WHEN max(frame_seq) = any_value(n) - 1 THEN any_value(n) ELSE max(frame_seq) END AS e, any_value(n) AS n FROM ru WHERE d = 1 GROUP BY uuid, k),
lo AS (SELECT * FROM iv WHERE e - s > 3),
nw AS (SELECT *, CAST(lag(e) OVER (PARTITION BY uuid ORDER BY s) IS NULL OR s - lag(e) OVER (PARTITION BY uuid ORDER BY s) >= 6 AS INT) AS new FROM lo),
il AS (SELECT *, sum(new) OVER (PARTITION BY uuid ORDER BY s) AS g FROM nw),
mg AS (SELECT uuid, min(s) AS s, max(e) AS e, any_value(n) AS n FROM il GROUP BY uuid, g),
kr AS (SELECT uuid, coalesce(lag(e) OVER (PARTITION BY uuid ORDER BY s), 0) AS start, s AS stop FROM mg UNION ALL SELECT uuid, max(e), any_value(n) FROM mg GROUP BY uuid),
kp AS (SELECT *, CAST(row_number() OVER (PARTITION BY uuid ORDER BY start) - 1 AS INTEGER) AS idx FROM kr WHERE start < stop)"""
)


def _empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).withColumn("empty", F.col("value") < 25)


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.empty_intervals(intervals.dilate(_empty(spark, sf_dir), width=3), longer_than=3)


@query(f"WITH {E_SQL} SELECT uuid, CAST(sum(CAST(empty AS INT)) AS BIGINT) AS n_empty, count(*) AS n_frames, round(100.0 * sum(CAST(empty AS INT)) / count(*), 6) AS percent, 10 * sum(CAST(empty AS INT)) >= count(*) AS flagged FROM em GROUP BY uuid")
def empty_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.empty_fraction(_empty(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


@query(f"WITH {I_SQL} SELECT uuid, frame_seq, d = 1 AS dilated FROM dl")
def dilated_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.dilate(_empty(spark, sf_dir), width=3).select("uuid", "frame_seq", "dilated")


@query(f"WITH {I_SQL} SELECT uuid, s, e, n AS n_frames FROM lo")
def empty_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intervals(spark, sf_dir)


@query(f"WITH {I_SQL} SELECT uuid, s, e, n AS n_frames FROM mg")
def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_intervals(_intervals(spark, sf_dir), gap=6)


@query(f"WITH {I_SQL} SELECT uuid, start, stop, idx FROM kp")
def kept_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.kept_ranges(intervals.merge_intervals(_intervals(spark, sf_dir), gap=6)).select("uuid", "start", "stop", "idx")


@query(f"WITH {I_SQL} SELECT uuid, start, stop, idx FROM kp")
def long_kept_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9 and W11-W14 for recordings too long for one task, in small chunks."""
    dilated = long_intervals.dilate(_empty(spark, sf_dir), width=3, chunk=16)
    merged = long_intervals.merge_intervals(long_intervals.empty_intervals(dilated, longer_than=3, chunk=16), gap=6, chunk=16)
    return long_intervals.kept_ranges(merged, chunk=16)


@query(f"WITH {I_SQL} SELECT CAST(f.uuid AS VARCHAR) || '-split-' || lpad(CAST(idx AS VARCHAR), 2, '0') AS split_id, f.uuid, frame_seq, frame_seq - start AS split_seq FROM f JOIN kp ON f.uuid = kp.uuid AND frame_seq >= start AND frame_seq < stop")
def range_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = intervals.kept_ranges(intervals.merge_intervals(_intervals(spark, sf_dir), gap=6))
    return intervals.split_by_ranges(frames(spark, sf_dir), ranges).select("split_id", "uuid", "frame_seq", "split_seq")


@query(
    f"""WITH {I_SQL}, a AS (SELECT uuid, 'value' AS name, frame_seq, value FROM f UNION ALL SELECT uuid, 'highest', NULL, max(value) FROM f GROUP BY uuid)
SELECT CAST(uuid AS VARCHAR) || '-split-' || printf('%02d', idx) AS uuid, name, frame_seq - start AS frame_seq, value FROM a JOIN kp USING (uuid) WHERE frame_seq IS NULL OR (frame_seq >= start AND frame_seq < stop)
UNION ALL SELECT CAST(uuid AS VARCHAR), name, frame_seq, value FROM a WHERE uuid NOT IN (SELECT uuid FROM kp)"""
)
def split_whole_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO12: data sets by frame sliced, one of the whole session copied into each split, and sessions without ranges kept."""
    f = frames(spark, sf_dir)
    data = f.select("uuid", F.lit("value").alias("name"), "frame_seq", "value").unionByName(f.groupBy("uuid").agg(F.lit("highest").alias("name"), F.lit(None).cast("long").alias("frame_seq"), F.max("value").alias("value")))
    ranges = intervals.kept_ranges(intervals.merge_intervals(_intervals(spark, sf_dir), gap=6))
    return session_store.split_sessions({"data": data}, ranges, keep_whole=True)["data"]


@query(f"WITH {F_SQL} SELECT uuid, frame_seq, CASE WHEN frame_seq < 40 THEN CAST(CAST(floor(ts_ms) AS BIGINT) AS VARCHAR) ELSE '' END AS \"timestamp\", value FROM f")
def scalar_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    scalars = f.select("uuid", F.lit("scalars/value").alias("name"), "frame_seq", F.col("ts_ms").alias("ts"), "value")
    ts = f.where("frame_seq < 40").select("uuid", "frame_seq", F.floor("ts_ms").cast("long").alias("ts"))
    return session_store.with_timestamps(session_store.extract(scalars, "value"), ts)


@query(f"WITH {F_SQL} SELECT 'scalars/' || label AS name, count(*) AS n_values, 'double' AS dtype FROM f GROUP BY label")
def scalar_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return session_store.list_datasets(f.select(F.concat(F.lit("scalars/"), "label").alias("name"), "value"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '^.*/', ''), '(.)\\.[^.]*$', '\\1') AS stem, replace(url, '.com', '') AS cleaned FROM pages")
def filename_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.stem(F.col("url")).alias("stem"), X.without_literal(F.col("url"), ".com").alias("cleaned"))


@query("SELECT page_id, replace(array_to_string(list_transform(string_split(url, '/'), lambda x: CASE WHEN x = 'en' THEN '/data/en' ELSE x END), '/'), '//', '/') AS path FROM pages")
def path_component_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.replace_component(F.col("url"), "en", "/data/en").alias("path"))


def _index_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Target files (path) and source files (path, group, position)."""
    p = table(spark, sf_dir, "pages")
    target = p.where("page_id % 2 = 0").select(F.col("url").alias("path")).distinct()
    source = p.where("page_id % 5 <> 0").select(F.col("url").alias("path"), F.concat(F.lit("g"), (F.col("page_id") % 3).cast("string")).alias("group"), F.col("page_id").alias("position"))
    return target, source


@query(
    """WITH t AS (SELECT url AS path, string_split(url, '/')[-1] AS name FROM pages WHERE page_id % 2 = 0 GROUP BY url),
s AS (SELECT url, lang_group, position, string_split(url, '/')[-1] AS name FROM (SELECT url, page_id AS position, 'g' || CAST(page_id % 3 AS VARCHAR) AS lang_group FROM pages WHERE page_id % 5 <> 0)),
m AS (SELECT t.path, s.lang_group, s.url, row_number() OVER (PARTITION BY t.path ORDER BY s.position) AS k FROM t LEFT JOIN s ON t.name = s.name)
SELECT path, lang_group AS source_group, url IS NOT NULL AS found FROM m WHERE k = 1"""
)
def treatment_suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By equal last components, as its SQL says; ``treatment_path_suffix`` has the rule of F16."""
    return treatments.groups_by_name(*_index_files(spark, sf_dir))


@query(
    r"""WITH t AS (SELECT url AS path, coalesce(list_filter(string_split(url, '/'), lambda x: x <> '' AND x <> '.')[-1], '') AS name FROM pages WHERE page_id % 2 = 0 GROUP BY url),
s AS (SELECT url, page_id AS position, 'g' || CAST(page_id % 3 AS VARCHAR) AS source_group FROM pages WHERE page_id % 5 <> 0),
m AS (SELECT t.path, s.source_group, s.url, row_number() OVER (PARTITION BY t.path ORDER BY s.position) AS k FROM t LEFT JOIN s ON ends_with(s.url, t.name))
SELECT path, source_group, url IS NOT NULL AS found FROM m WHERE k = 1"""
)
def treatment_path_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16 and S7 as the reference has them: the first source whose path ends in the target's name."""
    return treatments.groups_by_suffix(*_index_files(spark, sf_dir))


@query(
    f"""WITH {F_SQL}, c AS (SELECT uuid, CASE WHEN frame_seq < 3 THEN -5 ELSE CAST(length(label) AS INTEGER) END AS code, label FROM f)
SELECT uuid, code, count(*) AS n FROM c WHERE code <> -5 AND uuid IN (SELECT o_custkey FROM orders) GROUP BY ALL"""
)
def usable_frame_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first three frames of a session are its warm-up, and sessions of users who ordered count."""
    coded = frames(spark, sf_dir).withColumn("code", F.when(F.col("frame_seq") < 3, F.lit(features.SENTINEL)).otherwise(F.length("label")).cast("int"))
    sessions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uuid"))
    return features.usable_frames(coded, sessions, label="code").groupBy("uuid", "code").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {F_SQL} SELECT DISTINCT label, CASE WHEN label = 'signup' THEN 'click' ELSE label END AS new_label FROM f")
def merged_label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which label each one became."""
    merged = usage.relabel(frames(spark, sf_dir), spark.createDataFrame(MERGES[:1], "old string, new string"))
    return usage.label_map(merged, "label", "new_label")


@query(
    f"""WITH {F_SQL}, t AS (SELECT uuid, frame_seq, CASE WHEN frame_seq % 4 <> 3 THEN CAST(CAST(floor(ts_ms) AS BIGINT) AS VARCHAR) ELSE '' END AS ts, round(value * 100) AS cents FROM f)
SELECT uuid, count(*) AS n, string_agg(ts, ',' ORDER BY frame_seq) AS timestamps, CAST(sum(cents) AS BIGINT) AS cents FROM t GROUP BY uuid"""
)
def session_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document per session, parsed again; a frame without a time stamp has an empty one."""
    f = frames(spark, sf_dir)
    ts = f.where("frame_seq % 4 <> 3").select("uuid", "frame_seq", F.floor("ts_ms").cast("long").alias("ts"))
    documents = session_store.to_json(session_store.with_timestamps(f.select("uuid", "frame_seq", "value"), ts))
    d = F.from_json("document", "data array<double>, timestamps array<string>")
    cents = F.aggregate(F.transform(d["data"], lambda x: F.round(x * 100).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return documents.select("uuid", F.size(d["data"]).cast("long").alias("n"), F.array_join(d["timestamps"], ",").alias("timestamps"), cents.alias("cents"))
