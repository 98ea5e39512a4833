"""The programs end to end on small made-up recordings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlab.operators import plots
from seqlab.plans import programs
from seqlab.plans.registry import Library
from seqlab.sources import session_store, tables


@pytest.fixture(scope="module")
def recordings(spark):
    """Frames with kinematics, scores, labels of resamples; labels 0 and 1 are confused with one another."""
    rng = np.random.default_rng(0)
    frames, scores, resamples = [], [], []
    for u in ("s1", "s2", "s3"):
        seq, label = 0, 0
        while seq < 240:
            n = int(rng.integers(6, 14))
            for k in range(n):
                angle = 0.1 * k * (1 if label != 2 else -1)
                frames.append((u, seq, int(label) if seq >= 3 else -5, k == 0, 33.3 * seq, float(angle), 10.0 + label + 0.3 * k, 5.0 + k, 4.0 + label, 20.0 + k, "g"))
                if seq >= 3:
                    base = 0 if label < 2 else label
                    scores.append((u, seq, (rng.normal(size=10) * 0.1 + np.eye(10)[base] * 3).tolist()))
                swap = rng.random() < 0.5 and label < 2
                for r in range(6):
                    resamples.append((u, seq, r, int(1 - label) if swap and r < 3 else int(label)))
                seq += 1
            label = int(rng.integers(0, 4))
    f = spark.createDataFrame(frames, "uuid string, frame_seq long, label int, onset boolean, ts_ms double, angle double, height_ave_mm double, width_mm double, length_mm double, velocity_3d_mm double, group string")
    return f.cache(), spark.createDataFrame(scores, "uuid string, frame_seq long, pc array<double>").cache(), spark.createDataFrame(resamples, "uuid string, frame_seq long, resample int, label int").cache()


def test_redundant_labels_are_merged(recordings):
    frames, scores, resamples = recordings
    merges = programs.redundant_labels(resamples, scores, transition_threshold=0.6)
    found = {(r["old"], r["new"]) for r in merges.collect()}
    assert found and found <= {(0, 1), (1, 0)}
    out, same, stats = programs.merge_labels(frames, merges)
    assert 0 < same.first()["percent_equal"] < 100
    assert out.count() == frames.count() and stats.count() > 0


def test_flip_quality(spark, recordings):
    frames, _, resamples = recordings
    labels = frames.select("uuid", "frame_seq", "label")
    flipped = labels.withColumn("label", F.when(F.col("label").isin(0, 1) & (F.col("frame_seq") % 2 == 0), 1 - F.col("label")).otherwise(F.col("label")))
    report = programs.flip_quality(frames, labels, flipped, confusion_threshold=0.1, kinematic_threshold=-1.0)
    assert 0 < report.agreement.first()["agreement"] < 100
    assert {(r["syll_i"], r["syll_j"]) for r in report.pairs.collect()} <= {(0, 1)}
    assert report.merge_map.columns == ["old", "new"]
    none = programs.flip_quality(frames, labels, labels)
    assert none.candidates.count() == 0 and none.agreement.first()["agreement"] == 100


def test_features_and_library(spark, recordings, tmp_path):
    frames, scores, _ = recordings
    rng = np.random.default_rng(1)
    ar = spark.createDataFrame([(k, i, rng.normal(size=7).tolist()) for k in range(4) for i in range(2)], "label int, row int, values array<double>")
    table = programs.syllable_features(frames, scores, ar)
    assert sorted(r["syllable_id"] for r in table.collect()) == [0, 1, 2, 3]
    assert table.agg(F.sum("normalized_frequency")).first()[0] == pytest.approx(1)
    columns = ["a", "b", "c", "normalized_frequency"]
    made = lambda seed, n: spark.createDataFrame([(i, *(np.random.default_rng(seed + i).normal(size=3) + 5 * (i % 3)).tolist(), 0.1) for i in range(n)], "syllable_id int, a double, b double, c double, normalized_frequency double")
    experiments = {"x": made(0, 15), "y": made(100, 15)}
    truth = spark.createDataFrame([(e, i, str(i % 3)) for e in "xy" for i in range(15)], "experiment_name string, syllable_id int, ground_truth_label string")
    assigned, contingency = programs.meta_clusters(experiments, columns[:3], ground_truth=truth, n_clusters=3, pc_components=2, normalization="zscore")
    assert assigned.count() == 30 and contingency.agg(F.sum("n")).first()[0] == 30
    library = Library(str(tmp_path))
    version = programs.generate_library(spark, library, experiments, columns, n_clusters=3, pc_components=2, normalization="zscore")
    assert version == "v1.0" and "normalized_frequency" not in library.manifest()["versions"][0]["features"]
    for i, options in enumerate([{}, {"update_centroids": False}, {"create_new_clusters": True, "distance_threshold": 1e-6}]):
        version = programs.add_to_library(spark, library, "v1.0", {"z": made(200, 9)}, **options)
        assert version == f"v1.{i + 1}"
        rows = library.load(spark, version)["library"]
        assert rows.count() == 39 and rows.where("library_label is null").count() == 0
        assert rows.groupBy("origin").count().count() == 2


def test_cosine_and_empty_ranges(spark):
    stats = spark.createDataFrame([("g", "u", 1, 0.5), ("g", "u", 2, 0.5), ("h", "v", 2, 1.0), ("h", "v", 3, 0.001)], "group string, uuid string, syllable int, usage double")
    groups, subjects = programs.cosine_distances(stats, stats)
    assert groups.count() == 4 and subjects.count() == 8
    frames = spark.createDataFrame([("a", i, 400 <= i < 800) for i in range(1500)] + [("b", i, False) for i in range(10)], "uuid string, frame_seq long, empty boolean")
    share, kept = programs.empty_ranges(frames)
    assert {r["uuid"]: r["flagged"] for r in share.collect()} == {"a": True, "b": False}
    assert sorted((r["start"], r["stop"]) for r in kept.collect()) == [(0, 395), (803, 1500)]


def test_plot_tables(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(5)] + [("b", None)], "g string, x double")
    q = {r["g"]: r for r in plots.box_quantiles(rows, "x", ["g"]).collect()}
    assert (q["a"]["low"], q["a"]["median"], q["a"]["high"]) == (0.0, 2.0, 4.0) and q["b"]["median"] is None
    assert sorted((r["bin"], r["n"]) for r in plots.histogram(rows, "x", bins=2).collect()) == [(0, 2), (1, 3)]
    assert plots.mean_with_error(rows, "x", ["g"]).where("g = 'a'").first()["mean"] == 2.0


def test_retired_source(tmp_path):
    (tmp_path / "x.h5").write_text("")
    tables.write_yaml({"uuid": "u"}, f"{tmp_path}/x.yaml")
    made = session_store.retire_source(f"{tmp_path}/x.h5", f"{tmp_path}/x.yaml", 2)
    assert (tmp_path / "x.h5.orig").exists() and [tables.read_yaml(p)["uuid"] for p in made] == ["u-split-00", "u-split-01"]
