"""The programs end to end: one function each, DataFrames in and out, with the customary defaults.

Nothing here prompts, configures logging or changes inputs; results are lazy
unless a choice (of k, of new clusters) needs a number from the data.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.operators import cluster, features, intervals, long_intervals, long_sessions, normalize, resample, sequence, similarity, treatments, usage
from seqlab.plans.registry import Library
from seqlab.sources import session_files, session_store, tables
from seqlab.sources.scratch import saved

log = logging.getLogger(__name__)

#: Frames at the start of a session that have no scores.
UNSCORED = 3

KINEMATICS = {"height_ave_mm": "height_mm", "width_mm": "width_mm", "length_mm": "length_mm", "velocity_3d_mm": "speed_3d_mm_s"}


def cosine_distances(a: DataFrame, b: DataFrame, *, usage_threshold: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """(group by group, subject by group) cosine distances of two stats tables (group, uuid, syllable, usage)."""
    a, b = (x.where(F.col("usage") > usage_threshold) for x in (a, b))
    groups = [x.groupBy("group", "syllable").agg(F.avg("usage").alias("usage")) for x in (a, b)]
    by_group = similarity.cosine_distances(*groups, keys_l=["group"], keys_r=["group"]).withColumnsRenamed({"a_group": "group1", "b_group": "group2"})
    subjects = [x.groupBy("group", "uuid", "syllable").agg(F.avg("usage").alias("usage")) for x in (a, b)]
    return by_group, similarity.both_directions(*subjects)


def redundant_labels(resamples: DataFrame, scores: DataFrame, *, entropy_threshold: float = 0.5, transition_threshold: float = 0.25, k: int = 2, frame: Sequence[str] = ("uuid", "frame_seq")) -> DataFrame:
    """The merge map (old, new, similarity) of labels that resamples confuse and whose mean scores are alike.

    ``resamples``: uuid, frame_seq, resample, label; ``scores``: uuid, frame_seq, pc.
    Raises ValueError without resamples, or if a session's usable frames and
    scores differ in number.
    """
    if "resample" not in resamples.columns:
        raise ValueError("the labels hold no resamples")
    frame = list(frame)
    valid = resample.valid_frames(resamples, frame=frame)
    scored = F.col(frame[-1]) >= UNSCORED
    similarity.check_same_frames(valid.where(scored).select(*frame).distinct(), scores.where(scored), frame[0])
    entropies = resample.transition_entropy(valid, frame=frame, resample=["resample"])
    stable = resample.stable_frames(entropies, session=frame[:-1], order=frame[-1:], threshold=transition_threshold)
    top = resample.top_labels(valid.join(stable.select(*frame), frame, "left_semi"), k=k, frame=frame)
    near = resample.neighbours(resample.conditional_entropy(top, frame=frame), threshold=entropy_threshold, k=k)
    long = similarity.to_long(scores, frame, "pc")
    stats = long.groupBy("dim").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    scaled = long.join(F.broadcast(stats), "dim").withColumn("value", F.try_divide(F.col("value") - F.col("m"), F.col("s")))
    means = scaled.join(top.where("rank = 1").select(*frame, "label"), frame).groupBy("label", "dim").agg(F.avg("value").alias("value"))
    cosine = similarity.cosine_distances(means, means, keys_l=["label"], keys_r=["label"], dim="dim", value="value")
    return resample.merge_candidates(near, cosine.select(F.col("a_label").alias("i"), F.col("b_label").alias("j"), (1 - F.col("cosine_distance")).alias("similarity")))


def merge_labels(frames: DataFrame, merge_map: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(relabelled frames, percentage that stayed, usage statistics per group, session and new label)."""
    out = usage.relabel(frames, merge_map)
    out = sequence.mark_onsets(out.drop("onset"), label="new_label")
    metrics = [m for m in KINEMATICS if m in frames.columns]
    return out, usage.percent_equal(out, "label", "new_label"), usage.group_usage_stats(out, metrics, label="new_label")


@dataclass
class FlipReport:
    agreement: DataFrame
    per_label: DataFrame
    pairs: DataFrame
    candidates: DataFrame
    merge_map: DataFrame


def flip_quality(frames: DataFrame, labels: DataFrame, flipped: DataFrame, *, confusion_threshold: float = 0.35, kinematic_threshold: float = 0.85, pair_threshold: float = 0.1, horizon_s: float = 0.4, fps: float | None = None, long_from: int = long_sessions.LONG) -> FlipReport:
    """Agreement of labels with those of flipped recordings, and labels to merge.

    ``labels``, ``flipped``: uuid, frame_seq, label. ``frames``: the frame table
    with onset, angle and kinematics. The frame rate is taken from timestamps
    unless it is given. No candidate gives empty tables. Sessions are gone
    through in chunks if one has more than ``long_from`` frames.
    """
    similarity.check_same_sessions(labels, flipped)
    both = labels.where("label >= 0").join(flipped.where("label >= 0").withColumnRenamed("label", "flipped"), ["uuid", "frame_seq"])
    jaccard = similarity.label_jaccard(both)
    per_label = jaccard.where("i = j").orderBy(F.desc("jaccard"), "i")
    fps = fps or sequence.sampling_rate(frames).first()["fps"]
    by = long_sessions if long_sessions.needed(frames, most=long_from) else sequence
    runs = by.number_runs(by.run_durations(frames))
    aligned = sequence.align_to_onset(runs, value="angle").withColumn("angle", F.col("aligned"))
    aligned = sequence.duration_band(aligned, fps=fps)
    metrics = ["angle", "velocity_3d_mm", "height_ave_mm", "length_mm"]
    trajectories = sequence.mean_trajectories(aligned, metrics, fps=fps, horizon_s=horizon_s)
    pairs = similarity.similar_pairs(jaccard, pair_threshold)
    raw = similarity.trajectory_correlation(trajectories, metrics, pairs, flip="angle")
    z = similarity.zscore(trajectories, metrics, by=["label"]).select("label", "offset", *(F.col(f"z_{m}").alias(m) for m in metrics))
    scaled = similarity.trajectory_correlation(z, metrics, pairs, flip="angle").withColumnRenamed("correlation", "correlation_z")
    found = pairs.select("i", "j", F.col("jaccard").alias("confusion_rate")).join(raw, ["i", "j"]).join(scaled, ["i", "j"], "left")
    found = found.withColumnsRenamed({"i": "syll_i", "j": "syll_j"})
    directed = usage.merge_directions(found, usage.label_usage(frames))
    accepted = similarity.accept_candidates(directed, kinematic=kinematic_threshold, confusion=confusion_threshold)
    return FlipReport(similarity.agreement(both), per_label, directed, accepted, accepted.select(F.col("to_merge").alias("old"), F.col("merge_into").alias("new")))


def empty_ranges(frames: DataFrame, *, empty_threshold: float = 10.0, split_threshold: int = 150, filter_size: int = 9, long_from: int = long_sessions.LONG) -> tuple[DataFrame, DataFrame]:
    """(empty share per recording, ranges to keep of flagged recordings). ``frames``: uuid, frame_seq, empty.

    Recordings are gone through in chunks if one has more than ``long_from`` frames.
    """
    by = long_intervals if long_sessions.needed(frames, most=long_from) else intervals
    share = intervals.empty_fraction(frames, threshold=empty_threshold)
    flagged = frames.join(share.where("flagged").select("uuid"), "uuid", "left_semi")
    found = by.empty_intervals(by.dilate(flagged, width=filter_size), longer_than=split_threshold)
    return share, by.kept_ranges(by.merge_intervals(found, gap=2 * split_threshold))


@dataclass
class SplitReport:
    share: DataFrame
    ranges: DataFrame
    splits: DataFrame
    tables: dict[str, DataFrame]


def split_empty(sessions: dict[str, DataFrame], *, frames: str = "frames", height: int = 10, empty_threshold: float = 10.0, split_threshold: int = 150, filter_size: int = 9, long_from: int = long_sessions.LONG) -> SplitReport:
    """Sessions with too many empty frames cut into their ranges with a subject, with all their tables; others stay whole.

    ``sessions``: tables by name, each with uuid. That of the frames has
    frame_seq and either ``empty`` or pixels (px), of which one above the
    ``height`` makes a frame not empty. Ranges are written once, as every table
    is cut by them.
    """
    mask = sessions[frames] if "empty" in sessions[frames].columns else session_store.empty_mask(sessions[frames], height=height)
    share, ranges = empty_ranges(mask.select("uuid", "frame_seq", "empty"), empty_threshold=empty_threshold, split_threshold=split_threshold, filter_size=filter_size, long_from=long_from)
    ranges = saved(ranges, "ranges")
    return SplitReport(share, ranges, session_store.split_listing(ranges), session_store.split_sessions(sessions, ranges, keep_whole=True))


def slice_frames(frames: DataFrame, *, time_slice: tuple[float, float] = (0, 30)) -> DataFrame:
    """Frames within minutes of their session's start."""
    return sequence.slice_session(frames, start_min=time_slice[0], end_min=time_slice[1])


def syllable_features(frames: DataFrame, scores: DataFrame, ar: DataFrame, *, fps: float = 30.0, duration: str = "backward", eig: str = "eigh") -> DataFrame:
    """One row per label: kinematics, durations, frequency, components, dynamics.

    The default duration is the customary one, which gives a run the length of
    the run before; ``forward`` is its own length. Raises ValueError if a
    session's usable frames and scores differ in number.
    """
    usable = features.usable_frames(frames, scores)
    scored = F.col("frame_seq") >= UNSCORED
    similarity.check_same_frames(usable.where(scored), scores.where(scored))
    z = similarity.to_long(scores, ["uuid", "frame_seq"], "pc", 10)
    stats = z.groupBy("dim").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = z.join(F.broadcast(stats), "dim").groupBy("uuid", "frame_seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", F.try_divide(F.col("value") - F.col("m"), F.col("s")).alias("x")))), lambda s: s["x"]).alias("pc"))
    met = features.attach_scores(usable, z)
    onsets = sequence.run_durations(met, mode=duration).where("onset").withColumnsRenamed(KINEMATICS)
    out = features.label_features(onsets, list(KINEMATICS.values()), fps=fps, pc="pc")
    return out.join(features.dynamics_features(ar, mode=eig), "label", "left").withColumnRenamed("label", "syllable_id")


def _points(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    key = F.concat_ws("/", "experiment_name", F.col("syllable_id").cast("string"))
    return rows.select("experiment_name", "syllable_id", key.alias("id"), F.array(*columns).alias("features"))


def _clusters(points: DataFrame, n_clusters: int | None, algorithm: str, seed: int, pc_components: int, max_clusters: int):
    projected, components, variance = cluster.pca(points, pc_components)
    unit = similarity.l2_normalize(projected.drop("features").withColumnRenamed("pcs", "features"), "features")
    if algorithm == "affinity":
        return unit.join(cluster.affinity_propagation(unit).select("id", "cluster"), "id"), components, None
    k = n_clusters or cluster.choose_k(unit, seed=seed, most=max_clusters).first()["k"]
    assigned, centroids = cluster.kmeans(unit, k, seed=seed)
    log.info("%d clusters; %d components", k, components.count())
    return assigned, components, centroids


def meta_clusters(experiments: dict[str, DataFrame], columns: Sequence[str], *, ground_truth: DataFrame | None = None, n_clusters: int | None = None, algorithm: str = "kmeans", seed: int = 0, pc_components: int = 20, normalization: str = "robust_zscore", max_clusters: int = 300):
    """Labels of several experiments clustered together: (assigned, contingency with the ground truth or None)."""
    rows = normalize.preprocess(normalize.union_experiments(experiments), columns, method=normalization)
    assigned, _, _ = _clusters(_points(rows, columns), n_clusters, algorithm, seed, pc_components, max_clusters)
    assigned = assigned.select("experiment_name", "syllable_id", F.col("cluster").alias("meta_cluster"), "features")
    table = None if ground_truth is None else cluster.contingency(assigned, ground_truth, on=["experiment_name", "syllable_id"], cluster="meta_cluster")
    return assigned, table


def generate_library(spark: SparkSession, library: Library, experiments: dict[str, DataFrame], columns: Sequence[str], *, n_clusters: int | None = None, seed: int = 0, pc_components: int = 20, normalization: str = "robust_zscore", pipelines: dict | None = None, filter_quality: bool = False) -> str:
    """Cluster the experiments' labels and save them as a new major version; the version's name."""
    columns = [c for c in columns if c != "normalized_frequency"]
    rows = normalize.preprocess(normalize.union_experiments(experiments), columns, method=normalization, order="normalize_first", mad_scope="global")
    rows = _classified(rows, columns, pipelines, filter_quality)
    assigned, components, centroids = _clusters(_points(rows, columns), n_clusters, "kmeans", seed, pc_components, 300)
    means = _points(rows, columns).select(F.posexplode("features").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"))
    tables = {"library": assigned.withColumnRenamed("cluster", "library_label"), "components": components, "means": means, "centroids": centroids}
    return library.save(tables, initial=True, normalization=normalization, features=columns)


def _classified(rows: DataFrame, columns: Sequence[str], pipelines: dict | None, filter_quality: bool) -> DataFrame:
    if pipelines:
        rows = cluster.apply_classifiers(rows, pipelines, columns)
    if filter_quality:
        if "syllable_quality" not in rows.columns:
            log.warning("there is no syllable_quality to filter by")
            return rows
        rows, _ = cluster.split_quality(rows)
    return rows


def add_to_library(spark: SparkSession, library: Library, version: str, experiments: dict[str, DataFrame], *, distance_threshold: float = 0.65, update_centroids: bool = True, create_new_clusters: bool = False, pipelines: dict | None = None, filter_quality: bool = False) -> str:
    """Assign new experiments' labels to a version's clusters and save a new minor version; its name.

    The stored features, normalisation and components are used, by name.
    Labels beyond the threshold are flagged; with ``create_new_clusters`` they
    get clusters of their own, else centroids move slightly (``update_centroids``).
    """
    entry = next(v for v in library.manifest()["versions"] if v["version"] == version)
    columns, tables = entry["features"], library.load(spark, version)
    rows = normalize.preprocess(normalize.union_experiments(experiments), columns, method=entry["normalization_type"], order="normalize_first", mad_scope="global")
    points = _points(_classified(rows, columns, pipelines, filter_quality), columns)
    mean = tables["means"].agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("_mean"))
    loadings = tables["components"].agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "loadings"))), lambda s: s["loadings"]).alias("_loadings"))
    centred = F.zip_with("features", "_mean", lambda x, m: x - m)
    dot = lambda w: F.aggregate(F.zip_with("_c", w, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    pcs = points.join(F.broadcast(mean)).join(F.broadcast(loadings)).withColumn("_c", centred).withColumn("features", F.transform("_loadings", dot)).drop("_mean", "_loadings", "_c")
    unit = similarity.l2_normalize(pcs, "features")
    centroids = tables["centroids"]
    flagged = cluster.flag_new(cluster.assign(unit, centroids), threshold=distance_threshold)
    old = tables["library"].drop("library_label", "cluster_candidate", "origin")
    if create_new_clusters and not flagged.where("cluster_candidate").isEmpty():
        out, centroids = cluster.add_clusters(old, flagged, centroids)
    elif update_centroids:
        out, centroids = cluster.update_centroids(old, flagged.drop("cluster", "distance", "cluster_candidate"), centroids)
    else:
        kept = tables["library"].withColumnRenamed("library_label", "cluster").withColumn("origin", F.lit("old"))
        out = kept.unionByName(flagged.drop("distance", "cluster_candidate").withColumn("origin", F.lit("new")), allowMissingColumns=True)
    marks = flagged.select("id", "cluster_candidate")
    out = out.drop("distance", "cluster_candidate").join(marks, "id", "left").withColumnRenamed("cluster", "library_label")
    saved = {"library": out, "components": tables["components"], "means": tables["means"], "centroids": centroids}
    return library.save(saved, initial=False, normalization=entry["normalization_type"], features=columns)


def merge_treatments(file_map: DataFrame, dosing: DataFrame, index_path: str) -> DataFrame:
    """Set the groups of an index document to the treatments of its files, keeping the first version as .bak; its files with ``changed``."""
    document = tables.read_yaml(index_path)
    files = treatments.index_to_rows(file_map.sparkSession, document)
    out = treatments.update_groups(files, treatments.merge_schedules(*treatments.with_positions(file_map, dosing)))
    tables.write_yaml(treatments.rows_to_index(document, out), index_path)
    return out


def merge_treatments_from_index(spark: SparkSession, target_path: str, source_path: str) -> DataFrame:
    """Set the groups of an index document to those of another one's files whose paths end in the same name; the target's files with ``found``."""
    target, source = (tables.read_yaml(p) for p in (target_path, source_path))
    met = treatments.groups_by_suffix(treatments.index_to_rows(spark, target), treatments.index_to_rows(spark, source))
    out = met.withColumn("group", F.when(F.col("found"), F.col("source_group")).otherwise(F.col("group"))).drop("source_group")
    tables.write_yaml(treatments.rows_to_index(target, out), target_path)
    return out


def extract_scalar(spark: SparkSession, pattern: str, name: str, path: str, *, kind: str = "csv") -> None:
    """A named scalar of session files, with its time stamps, as one CSV or JSON document per session; only that dataset is read. Raises KeyError if no file has it."""
    full = name if name.startswith(session_store.PREFIX) else f"{session_store.PREFIX}{name}"
    rows = session_store.extract(session_files.read_sessions(spark, pattern, names=[full]), full)
    stamps = F.coalesce(F.col("ts").cast("string"), F.lit(""))
    session_files.export_sessions(rows.select("uuid", "frame_seq", stamps.alias("timestamp"), "value"), path, kind=kind)
