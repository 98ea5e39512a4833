"""Semantics of the core operators on small literal tables, with the edge rows that matter for each."""

import math
import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqlab.functions import text as X
from seqlab.operators import cluster, features, intervals, normalize, resample, sequence, similarity, treatments, usage
from seqlab.plans import registry, settings
from seqlab.sources import session_store, tables

#: Two sessions in mixed storage order; s2's first frame is no onset; one-frame runs.
FRAMES = [
    ("s1", 0, "a", True), ("s2", 0, "x", False), ("s1", 1, "a", False), ("s2", 1, "b", True), ("s1", 2, "b", True), ("s2", 2, "b", False),
    ("s1", 3, "a", True), ("s1", 4, "a", False), ("s1", 5, "a", False), ("s2", 3, "c", True),
]


@pytest.fixture
def frames(spark):
    return spark.createDataFrame(FRAMES, "uuid string, frame_seq long, label string, onset boolean")


def by_frame(df, column):
    return {(r["uuid"], r["frame_seq"]): r[column] for r in df.collect()}


def test_runs_start_at_zero_before_the_first_onset(frames):
    got = by_frame(sequence.number_runs(frames), "run_id")
    assert [got["s1", i] for i in range(6)] == [1, 1, 2, 3, 3, 3]
    assert [got["s2", i] for i in range(4)] == [0, 1, 1, 2]


def test_mark_onsets(frames):
    got = by_frame(sequence.mark_onsets(frames.drop("onset")), "onset")
    assert [got["s1", i] for i in range(6)] == [True, False, True, True, False, False]


def test_forward_durations_inherit_at_the_end(frames):
    got = by_frame(sequence.run_durations(frames), "run_frames")
    assert [got["s1", i] for i in range(6)] == [2, 2, 1, 1, 1, 1]
    assert [got["s2", i] for i in range(4)] == [None, 2, 2, 2]


def test_backward_durations_carry_the_run_before(frames):
    got = by_frame(sequence.run_durations(frames, mode="backward"), "run_frames")
    assert [got["s1", i] for i in range(6)] == [0, 0, 2, 1, 1, 1]
    assert [got["s2", i] for i in range(4)] == [None, 1, 1, 2]
    with pytest.raises(ValueError):
        sequence.run_durations(frames, mode="other")


def test_alignment_uses_the_first_two_values(spark):
    rows = spark.createDataFrame([("s", i, 1, v) for i, v in enumerate([4.0, 8.0, 9.0])] + [("s", 3, 2, 5.0)], "uuid string, frame_seq long, run_id long, value double")
    out = sequence.align_to_onset(rows, value="value")
    assert [by_frame(out, "aligned")["s", i] for i in range(4)] == [-2.0, 2.0, 3.0, 0.0]
    assert [by_frame(out, "offset")["s", i] for i in range(4)] == [0, 1, 2, 0]


def test_sampling_rate_is_the_exact_median(spark):
    rows = spark.createDataFrame([("a", i, t) for i, t in enumerate([0.0, 30.0, 65.0, 95.0])] + [("b", 0, 1e9)], "uuid string, frame_seq long, ts_ms double")
    assert sequence.sampling_rate(rows).first()["median_ms"] == 30.0


def test_slice_is_inclusive_and_drops_null_keys(spark):
    rows = spark.createDataFrame([("a", 100.0), ("a", 160_100.0), ("a", 60_100.0), ("a", 60_101.0), (None, 0.0)], "uuid string, ts_ms double")
    got = sequence.slice_session(rows, start_min=0, end_min=1, keys=("uuid",))
    assert sorted(r["ts_ms"] for r in got.collect()) == [100.0, 60_100.0]


def test_trajectory_horizon_is_inclusive_and_band_strict(spark):
    rows = spark.createDataFrame([("a", k, 1.0) for k in range(20)], "label string, offset long, v double")
    assert sequence.mean_trajectories(rows, ["v"], fps=30.0).agg(F.max("offset")).first()[0] == 12
    band = spark.createDataFrame([(3,), (4,), (29,), (30,)], "run_frames long")
    assert [r[0] for r in sequence.duration_band(band, fps=30.0).collect()] == [4, 29]


def brute_intervals(mask, longer, gap):
    n, out, i = len(mask), [], 0
    while i < n:
        if mask[i]:
            j = i
            while j + 1 < n and mask[j + 1]:
                j += 1
            out.append((i - 1, n if j == n - 1 else j))
            i = j
        i += 1
    out = [(s, e) for s, e in out if e - s > longer]
    merged = []
    for s, e in out:
        if merged and s - merged[-1][1] < gap:
            merged[-1] = (merged[-1][0], e)
        else:
            merged.append((s, e))
    kept, at = [], 0
    for s, e in merged:
        kept.append((at, s))
        at = e
    if merged:
        kept.append((at, n))
    return out, merged, [k for k in kept if k[0] < k[1]]


def test_intervals_by_brute_force(spark):
    rng = random.Random(4)
    masks = {"empty": [1] * 6, "full": [0] * 6, "starts": [1, 1, 0, 0, 1], "ends": [0, 1, 1]}
    masks |= {f"r{i}": [int(rng.random() < 0.5) for _ in range(rng.randint(1, 40))] for i in range(40)}
    rows = spark.createDataFrame([(u, i, bool(x)) for u, m in masks.items() for i, x in enumerate(m)], "uuid string, frame_seq long, dilated boolean")
    found = intervals.empty_intervals(rows, longer_than=1)
    merged = intervals.merge_intervals(found, gap=3)
    kept = intervals.kept_ranges(merged)
    of = lambda df, a, b, u: sorted((r[a], r[b]) for r in df if r["uuid"] == u)
    found, merged, kept = found.collect(), merged.collect(), kept.collect()
    for u, m in masks.items():
        x, y, z = brute_intervals(m, 1, 3)
        assert of(found, "s", "e", u) == x
        assert of(merged, "s", "e", u) == y
        assert of(kept, "start", "stop", u) == z


def test_dilation_cuts_at_the_ends(spark):
    rows = spark.createDataFrame([("a", i, i == 5) for i in range(12)], "uuid string, frame_seq long, empty boolean")
    assert sorted(i for (_, i), v in by_frame(intervals.dilate(rows), "dilated").items() if v) == list(range(1, 10))


def test_empty_fraction_threshold_is_inclusive(spark):
    rows = spark.createDataFrame([("a", i, i == 0) for i in range(10)], "uuid string, frame_seq long, empty boolean")
    assert intervals.empty_fraction(rows).first()["flagged"]


def test_relabel_is_one_pass_and_keeps_misses(spark):
    rows = spark.createDataFrame([(1,), (2,), (5,)], "label int")
    merges = spark.createDataFrame([(1, 2), (2, 3), (2, 1)], "old int, new int")
    assert {r["label"]: r["new_label"] for r in usage.relabel(rows, merges).collect()} == {1: 2, 2: 3, 5: 5}


def test_label_map_must_be_a_function(spark):
    assert usage.label_map(spark.createDataFrame([(1, 2), (1, 2)], "a int, b int"), "a", "b").count() == 1
    with pytest.raises(ValueError):
        usage.label_map(spark.createDataFrame([(1, 2), (1, 3)], "a int, b int"), "a", "b")


def test_merge_directions_with_ties_and_missing_usage(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 9)], "syll_i int, syll_j int")
    use = spark.createDataFrame([(1, 0.5), (2, 0.2), (3, 0.2)], "label int, usage double")
    got = {(r["syll_i"], r["syll_j"]): (r["merge_into"], r["to_merge"]) for r in usage.merge_directions(pairs, use).collect()}
    assert got == {(1, 2): (1, 2), (2, 3): (3, 2), (1, 9): (9, 1)}


def test_cosine_of_disjoint_and_zero_vectors(spark):
    a = spark.createDataFrame([("p", 1, 1.0), ("q", 2, 2.0), ("z", 1, 0.0)], "k string, syllable int, usage double")
    got = {(r["a_k"], r["b_k"]): r["cosine_distance"] for r in similarity.cosine_distances(a, a, keys_l=["k"], keys_r=["k"]).collect()}
    assert got["p", "q"] == 1.0 and got["p", "p"] == pytest.approx(0) and got["p", "z"] is None and len(got) == 9


def test_jaccard_by_one_hot(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 3), rng.randint(0, 3)) for _ in range(200)]
    df = spark.createDataFrame(pairs, "label int, flipped int")
    labels = spark.createDataFrame([(i,) for i in range(6)], "label int")
    a, b = np.array(pairs).T
    for r in similarity.label_jaccard(df, labels=labels).collect():
        x, y = a == r["i"], b == r["j"]
        both = (x | y).sum()
        assert r["jaccard"] == pytest.approx(1.0 if both == 0 else (x & y).sum() / both)
    assert similarity.label_jaccard(df).count() == len(set(pairs))


def test_sessions_must_match(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "uuid string"), spark.createDataFrame([("x",)], "uuid string")
    similarity.check_same_sessions(a, a)
    with pytest.raises(ValueError):
        similarity.check_same_sessions(a, b)


def test_trajectories_of_unequal_length_are_left_out_and_constants_are_null(spark):
    t = [("a", k, float(k), 1.0) for k in range(4)] + [("b", k, float(2 * k), 1.0) for k in range(4)] + [("c", 0, 1.0, 1.0)] + [("d", k, 3.0, 1.0) for k in range(4)]
    df = spark.createDataFrame(t, "label string, offset long, x double, y double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d")], "i string, j string")
    got = {(r["i"], r["j"]): r["correlation"] for r in similarity.trajectory_correlation(df, ["x", "y"], pairs).collect()}
    assert set(got) == {("a", "b"), ("a", "d")} and got["a", "b"] > 0.9 and got["a", "d"] is None


def test_zscore_without_spread_is_null(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", 2.0), ("c", 2.0)], "g string, x double")
    got = sorted((r["g"], None if r["z_x"] is None else round(r["z_x"], 6)) for r in similarity.zscore(rows, ["x"], by=["g"]).collect())
    assert got[:2] == [("a", -0.707107), ("a", 0.707107)] and [z for _, z in got[2:]] == [None] * 3


def test_transition_entropy_of_every_flip_is_zero(spark):
    rows = [(0, k, k % 2) for k in range(5)] + [(1, k, 7) for k in range(5)] + [(2, k, int(k > 2)) for k in range(5)]
    got = {r["frame"]: r["entropy"] for r in resample.transition_entropy(spark.createDataFrame(rows, "frame int, resample int, label int")).collect()}
    assert got[0] == got[1] == 0.0
    assert got[2] == pytest.approx(-(0.25 * math.log(0.25) + 0.75 * math.log(0.75)))


def test_stable_frames_look_one_frame_back(spark):
    rows = spark.createDataFrame([("s", i, e) for i, e in enumerate([0.0, 0.5, 0.0, 0.0])], "uuid string, frame int, entropy double")
    assert sorted(r["frame"] for r in resample.stable_frames(rows).collect()) == [0, 3]


def test_top_labels_ties_go_to_the_larger(spark):
    rows = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 4)], "frame int, label int")
    got = {(r["frame"], r["rank"]): (r["label"], r["share"]) for r in resample.top_labels(rows).collect()}
    assert got == {(0, 1): (3, 0.5), (0, 2): (2, 0.5), (1, 1): (4, 1.0)}


def test_neighbours_and_cycles(spark):
    top = spark.createDataFrame([(f, lab, 1, r, 0.5) for f in range(4) for r, lab in enumerate((1, 2))], "frame int, label int, n int, rank int, share double")
    near = resample.neighbours(resample.conditional_entropy(top))
    assert {(r["i"], r["j"]): r["mean_entropy"] for r in near.collect()} == {(1, 2): 1.0, (2, 1): 1.0}
    same = spark.createDataFrame([(1, 2, 0.3), (2, 1, 0.3)], "i int, j int, similarity double")
    merges = resample.merge_candidates(near, same)
    assert {(r["old"], r["new"]) for r in merges.collect()} == {(1, 2), (2, 1)}
    assert all(r["is_cycle"] for r in resample.merge_cycles(merges).collect())


def test_robust_zscore_scopes_and_zero_mad(spark):
    rows = spark.createDataFrame([("e", 1.0, 10.0), ("e", 2.0, 20.0), ("e", 4.0, 60.0), ("f", 3.0, 1.0), ("f", 3.0, 2.0)], "experiment_name string, a double, b double")
    x = np.array([[1.0, 10.0], [2.0, 20.0], [4.0, 60.0]])
    med = np.median(x, axis=0)
    for scope in ("column", "global"):
        mad = np.median(np.abs(x - med), axis=0) if scope == "column" else np.median(np.abs(x - med))
        want = (x - med) / (1.4826 * mad)
        got = [(r["z_a"], r["z_b"]) for r in normalize.robust_zscore(rows, ["a", "b"], mad_scope=scope).orderBy("experiment_name", "a").collect()]
        assert np.allclose(np.array(got[:3], float), want)
        assert scope == "global" or got[3][0] is None


def test_preprocess_orders_differ(spark):
    rows = spark.createDataFrame([("e", 1.0, 1.0), ("e", 3.0, float("nan")), ("e", 5.0, 2.0), ("e", 9.0, 4.0)], "experiment_name string, a double, b double")
    first = normalize.preprocess(rows, ["a", "b"], order="dropna_first")
    later = normalize.preprocess(rows, ["a", "b"], order="normalize_first")
    assert first.count() == later.count() == 3
    assert sorted(r["a"] for r in first.collect()) != sorted(r["a"] for r in later.collect())


def test_union_of_experiments_fills_missing_columns(spark):
    out = normalize.union_experiments({"x": spark.createDataFrame([(1,)], "a int"), "y": spark.createDataFrame([(2,)], "b int")})
    assert sorted(map(str, (tuple(r) for r in out.select("experiment_name", "a", "b").collect()))) == ["('x', 1, None)", "('y', None, 2)"]


def points(spark, n=30, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) + 6 * (np.arange(n) % 3)[:, None]
    return x, spark.createDataFrame([(i, int(i % 3), x[i].tolist()) for i in range(n)], "id int, cluster int, features array<double>")


def test_silhouette_by_numpy(spark):
    x, df = points(spark)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    c = np.arange(30) % 3
    want = {}
    for i in range(30):
        a = d[i, c == c[i]].sum() / (sum(c == c[i]) - 1)
        b = min(d[i, c == k].mean() for k in range(3) if k != c[i])
        want[str(i)] = (b - a) / max(a, b)
    got = {r["id"]: r["silhouette"] for r in cluster.silhouettes(df, block=7).collect()}
    assert got == pytest.approx(want)


def test_lloyd_step_and_empty_clusters(spark):
    x, df = points(spark)
    centroids = spark.createDataFrame([(0, x[0].tolist()), (1, x[1].tolist()), (2, [1e6] * 4)], "cluster int, centroid array<double>")
    near = np.argmin(((x[:, None] - np.array([x[0], x[1]])[None]) ** 2).sum(axis=2), axis=1)
    got = {r["cluster"]: r["centroid"] for r in cluster.lloyd_step(df.drop("cluster"), centroids).collect()}
    assert np.allclose(got[0], x[near == 0].mean(axis=0)) and np.allclose(got[1], x[near == 1].mean(axis=0)) and got[2] == [1e6] * 4


def test_new_clusters_are_appended(spark):
    x, df = points(spark)
    centroids = spark.createDataFrame([(0, x[0].tolist())], "cluster int, centroid array<double>")
    flagged = cluster.flag_new(cluster.assign(df.drop("cluster").where("id % 3 <> 0"), centroids), threshold=3.0)
    out, updated = cluster.add_clusters(df.drop("cluster").where("id % 3 = 0"), flagged, centroids, most=2)
    assert sorted(r["cluster"] for r in updated.collect()) == [0, 1, 2]
    by = {r["id"]: r["cluster"] for r in out.collect()}
    assert len({by[i] for i in range(0, 30, 3)}) == 1 and len(by) == 30 and len(set(by.values())) == 3


def test_pca_matches_numpy_and_is_centred(spark):
    x, df = points(spark, 40, 3)
    out, components, variance = cluster.pca(df, 2)
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    got = np.array([r["pcs"] for r in out.orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(centred @ vt[:2].T), atol=1e-6)
    assert np.allclose([r["ratio"] for r in variance.orderBy("component").collect()], (s**2 / (s**2).sum())[:2])
    assert all(max(r["loadings"], key=abs) > 0 for r in components.collect())


def test_affinity_finds_separate_groups(spark):
    _, df = points(spark, 30, 1)
    by = {int(r["id"]): r["cluster"] for r in cluster.affinity_propagation(df.drop("cluster")).collect()}
    groups = [{by[i] for i in range(k, 30, 3)} for k in range(3)]
    assert groups[0].isdisjoint(groups[1]) and groups[1].isdisjoint(groups[2])
    more = {int(r["id"]): r["exemplar"] for r in cluster.affinity_propagation(df.drop("cluster"), most=5, max_iter=30, stable=5).collect()}
    less = {int(r["id"]): r["exemplar"] for r in cluster.affinity_propagation(df.drop("cluster"), max_iter=30, stable=5).collect()}
    assert more == less  # by blocks of rows


def test_choose_k(spark):
    _, df = points(spark, 30, 2)
    best = cluster.choose_k(df.drop("cluster"), least=2, most=6, step=1).first()
    assert best["k"] == 3
    with pytest.raises(ValueError):
        cluster.choose_k(df)


def test_ar_dynamics(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(2, 7))
    ar = spark.createDataFrame([(5, i, m[i].tolist()) for i in range(2)], "label int, row int, values array<double>")
    companion = np.zeros((6, 6))
    companion[:2], companion[2:, :4] = m[:, :6], np.eye(4)
    for mode, solve in (("eigh", np.linalg.eigvalsh), ("eig", np.linalg.eigvals)):
        want = np.sort(np.abs(solve(companion)))[::-1]
        r = features.dynamics_features(ar, mode=mode).first()
        share = want / want.sum()
        assert r["spectral_radius"] == pytest.approx(want[0])
        assert r["dynamic_complexity"] == pytest.approx(-(share * np.log(share + 1e-10)).sum())
        assert r["eigval_6"] == pytest.approx(want[5]) and r["eigval_7"] is None


def test_label_features_of_a_single_onset(spark):
    rows = spark.createDataFrame([("a", 2.0, 30, [1.0]), ("b", 1.0, 15, [2.0]), ("b", 3.0, 45, [None])], "label string, v double, run_frames int, pc array<double>")
    got = {r["label"]: r for r in features.label_features(rows, ["v"], pc="pc", n_pc=2).collect()}
    assert got["a"]["std_v"] is None and got["b"]["avg_duration_s"] == 1.0 and got["b"]["normalized_frequency"] == pytest.approx(2 / 3)
    assert got["b"]["avg_pc_1"] == 2.0 and got["a"]["avg_pc_2"] is None


def test_usable_frames_and_scores(spark):
    f = spark.createDataFrame([("a", i, -5 if i < 3 else 1) for i in range(6)] + [("z", 5, 1)], "uuid string, frame_seq long, label int")
    s = spark.createDataFrame([("a", i, [float(i)]) for i in range(3, 6)], "uuid string, frame_seq long, pc array<double>")
    assert features.usable_frames(f, s).count() == 3
    assert sorted(r["pc"][0] for r in features.attach_scores(f, s).collect()) == [3.0, 4.0, 5.0]


def test_treatments(spark, tmp_path):
    fm = spark.createDataFrame([(1, None, "x.mp4.mp4"), (2, "d", "y.mp4"), (3, "d", None)], "matcher int, day string, filename string").selectExpr("*", "1 as session", "1 as box")
    ds = spark.createDataFrame([(1, None, "drug"), (9, "d", "none")], "matcher int, day string, treat string").selectExpr("*", "1 as session", "1 as box")
    merged = treatments.merge_schedules(fm, ds)
    got = {r["matcher"]: (r["filename_clean"], r["treat"]) for r in merged.collect()}
    assert got == {1: ("x", "drug"), 2: ("y", None), 3: (None, None), 9: (None, "none")}
    files = treatments.index_to_rows(spark, {"files": [{"path": ["/d/x.h5"], "group": "g"}, {"path": ["/d/y.h5"], "group": "g"}]})
    assert {r["path"]: (r["group"], r["changed"]) for r in treatments.update_groups(files, merged).collect()} == {"/d/x.h5": ("drug", True), "/d/y.h5": ("g", False)}
    twice = spark.createDataFrame([("x", 1, "zzz"), ("x", 3, "aaa"), ("x", 2, "mmm"), ("y", 1, "b"), ("y", 2, None)], "filename_clean string, day int, treat string")
    assert {r["path"]: r["group"] for r in treatments.update_groups(files, twice).collect()} == {"/d/x.h5": "aaa", "/d/y.h5": "g"}
    (tmp_path / "map.tsv").write_text("matcher\tday\tsession\tbox\tfilename\n2\t1\t1\t1\tx.mp4\n1\t1\t1\t1\tx.mp4\n2\t1\t1\t1\ty.mp4\n")
    (tmp_path / "dosing.tsv").write_text("matcher\tday\tsession\tbox\ttreat\n2\t1\t1\t1\tzzz\n2\t1\t1\t1\taaa\n1\t1\t1\t1\tmmm\n")
    placed = treatments.merge_schedules(*treatments.with_positions(*(tables.read_csv(spark, f"{tmp_path}/{n}.tsv", sep="\t") for n in ("map", "dosing"))))
    assert {r["path"]: r["group"] for r in treatments.update_groups(files, placed).collect()} == {"/d/x.h5": "aaa", "/d/y.h5": "aaa"}  # the last of equal keys, not the largest
    document = {"files": [{"path": ["/d/x.h5"], "group": "g"}], "other": 1}
    assert treatments.rows_to_index(document, treatments.update_groups(files, merged))["files"][0]["group"] == "drug"
    source = spark.createDataFrame([("/a/x.h5", "g1", 1), ("/b/x.h5", "g0", 0)], "path string, group string, position int")
    found = {r["path"]: (r["source_group"], r["found"]) for r in treatments.groups_by_suffix(files.select("path"), source).collect()}
    assert found == {"/d/x.h5": ("g0", True), "/d/y.h5": (None, False)}


def test_paths(spark):
    df = spark.createDataFrame([("/a/b.tar.gz",), ("x",), ("/d/.hidden",), ("/a/root/c.mp4.mp4",)], "p string")
    rows = df.select(X.stem(F.col("p")), X.suffix(F.col("p")), X.replace_component(F.col("p"), "root", "/new"), X.without_literal(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [("b.tar", ".gz", "/a/b.tar.gz", "/a/b.tar.gz"), ("x", "", "x", "x"), (".hidden", "", "/d/.hidden", "/d/.hidden"), ("c.mp4", ".mp4", "/a/new/c.mp4.mp4", "/a/root/c")]
    assert settings.apply_path({"a": "/x/root/y", "b": 3, "c": "keep"}, "/new", component="root") == {"a": "/x/new/y", "b": 3, "c": "keep"}
    assert settings.extraction_settings("/f.pkl")["flip_classifier"] == "/f.pkl" and settings.EXTRACTION["flip_classifier"] is None


def test_versions(spark, tmp_path):
    assert registry.parse_version("v1.10_x") == (1, 10) and registry.parse_version("other") == registry.parse_version(None) == (0, 0)
    df = spark.createDataFrame([("v1.0", True), ("v1.9", False), ("v1.10", False), ("v2.0", False), ("v1.2", False), ("bad", False)], "version string, is_original boolean")
    status = {r["version"]: r["status"] for r in registry.retention(df).collect()}
    assert status == {"v1.0": "Original", "v2.0": "Preserved", "v1.10": "Preserved", "v1.9": "Preserved", "v1.2": "Archived", "bad": "Archived"}
    lib, table = registry.Library(str(tmp_path)), spark.createDataFrame([(1,)], "x int")
    names = [lib.save({"library": table}, initial=i == 0 or i == 3, normalization="zscore", features=["x"], keep=2) for i in range(5)]
    assert names == ["v1.0", "v1.1", "v1.2", "v2.0", "v2.1"]
    shown = {r["version"]: r["status"] for r in lib.list_versions(spark, archived=True).collect()}
    assert shown == {"v1.0": "Original", "v1.1": "Archived", "v1.2": "Archived", "v2.0": "Update", "v2.1": "Update"}
    assert lib.restore("1.1") == "v1.1" and lib.load(spark, "v1.1")["library"].first()["x"] == 1
    for gone in ("v9.9", "v2.1"):
        with pytest.raises(FileNotFoundError):
            lib.restore(gone)
    with pytest.raises(FileNotFoundError):
        lib.load(spark, "v1.2")
    state = spark.createDataFrame([(c["seq"], c["action"], c["version"]) for c in lib.commits()], "seq long, action string, version string")
    assert {r["version"]: r["archived"] for r in registry.replay(state).collect()} == {c["version"]: c["archived"] for c in lib.manifest()["versions"]}
    assert [c["version"] for c in lib.manifest(at=2)["versions"]] == ["v1.0", "v1.1"]


def test_first_version_that_was_added_is_no_original(spark, tmp_path):
    lib, table = registry.Library(str(tmp_path)), spark.createDataFrame([(1,)], "x int")
    save = lambda initial: lib.save({"library": table}, initial=initial, normalization="zscore", features=["x"])
    assert save(False) == "v1.0" and lib.manifest()["original_library"] is None
    assert save(True) == "v2.0" and lib.manifest()["original_library"] == "v2.0"
    log = [{"seq": 1, "action": "save", "version": "draft", "is_initial_library": True}]
    assert lib._next(log, False) == lib._next([], False) == "v1.0"  # names that do not parse count as none


def test_two_writers_get_two_versions(spark, tmp_path, monkeypatch):
    tables = [spark.createDataFrame([(i,)], "x int") for i in range(2)]
    mine, theirs = registry.Library(str(tmp_path)), registry.Library(str(tmp_path))
    real, once = registry.Library._create, []

    def late(self, path, text):
        if self is mine and not once:  # the other writer commits between this one's reading and its commit
            once.append(theirs.save({"library": tables[1]}, initial=True, normalization="zscore", features=["x"]))
        return real(self, path, text)

    monkeypatch.setattr(registry.Library, "_create", late)
    assert mine.save({"library": tables[0]}, initial=True, normalization="zscore", features=["x"]) == "v2.0" and once == ["v1.0"]
    assert [mine.load(spark, v)["library"].first()["x"] for v in ("v1.0", "v2.0")] == [1, 0]
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda i: registry.Library(str(tmp_path), spark).save({"library": tables[i % 2]}, initial=False, normalization="zscore", features=["x"], keep=99), range(6)))
    assert sorted(made) == [f"v2.{i}" for i in range(1, 7)]
    assert [c["seq"] for c in mine.commits()] == list(range(1, 9))
    with pytest.raises(Exception, match="nothing"):
        mine.save({"library": tables[0].select(F.raise_error(F.lit("nothing")))}, initial=False, normalization="zscore", features=["x"])
    assert len(mine.commits()) == 8 and len(list(tmp_path.glob("library_*"))) == 8


def test_session_store(spark):
    s = spark.createDataFrame([("u", "scalars/h", i, float(i)) for i in range(3)], "uuid string, name string, frame_seq long, value double")
    ts = spark.createDataFrame([("u", 0, 10), ("u", 1, 20)], "uuid string, frame_seq long, ts long")
    out = session_store.with_timestamps(session_store.extract(s, "h"), ts)
    assert sorted((r["frame_seq"], r["timestamp"]) for r in out.collect()) == [(0, "10"), (1, "20"), (2, "")]
    assert session_store.to_json(out).first()["document"] == '{"data":[0.0,1.0,2.0],"timestamps":["10","20",""]}'
    with pytest.raises(KeyError):
        session_store.extract(s, "none")
    f = spark.createDataFrame([("u", 0, 2, 2, [1, 2, 3, 40])], "uuid string, frame_seq long, h int, w int, px array<int>")
    assert session_store.flip_frames(f).first()["px"] == [3, 40, 1, 2]
    assert not session_store.empty_mask(f).first()["empty"] and session_store.empty_mask(f, height=50).first()["empty"]


def test_sessions_are_split_with_all_their_tables(spark):
    frames = spark.createDataFrame([(u, i, i * 10) for u in ("a", "b") for i in range(6)], "uuid string, frame_seq long, v int")
    meta = spark.createDataFrame([("a", "x"), ("b", "y")], "uuid string, subject string")
    ranges = spark.createDataFrame([("a", 0, 2, 0), ("a", 4, 6, 1)], "uuid string, start long, stop long, idx int")
    out = session_store.split_sessions({"frames": frames, "meta": meta}, ranges)
    assert sorted(tuple(r) for r in out["frames"].collect()) == [("a-split-00", 0, 0), ("a-split-00", 1, 10), ("a-split-01", 0, 40), ("a-split-01", 1, 50)]
    assert sorted(tuple(r) for r in out["meta"].collect()) == [("a-split-00", "x"), ("a-split-01", "x")]


def test_splits_keep_what_no_range_cuts(spark):
    rows = [("a", 0, 1), ("a", 3, 2), ("a", None, 3), ("b", 0, 4), ("b", None, 5), (None, 0, 6)]
    data = spark.createDataFrame(rows, "uuid string, frame_seq long, start int")  # a column named as one of the ranges
    meta = spark.createDataFrame([("a", 7), ("b", 8), (None, 9)], "uuid string, idx int")
    ranges = spark.createDataFrame([("a", 0, 2, 0), ("a", 3, 6, 1)], "uuid string, start long, stop long, idx int")
    cut = [("a-split-00", 0, 1), ("a-split-00", None, 3), ("a-split-01", 0, 2), ("a-split-01", None, 3)]
    key = lambda r: tuple((x is not None, x) for x in r)
    for whole, kept, others in ((False, [], []), (True, rows[3:], [("b", 8), (None, 9)])):
        out = session_store.split_sessions({"data": data, "meta": meta}, ranges, keep_whole=whole)
        assert out["data"].columns == data.columns
        assert sorted((tuple(r) for r in out["data"].collect()), key=key) == sorted(cut + kept, key=key)
        assert sorted((tuple(r) for r in out["meta"].collect()), key=key) == sorted([("a-split-00", 7), ("a-split-01", 7), *others], key=key)
    none = session_store.split_sessions({"data": data}, ranges.where("false"), keep_whole=True)["data"]
    assert sorted((tuple(r) for r in none.collect()), key=key) == sorted(rows, key=key)
    assert sorted(tuple(r) for r in session_store.split_listing(ranges).collect())[1] == ("a", "a-split-01", 3, 6, "a-start_3_end_6.h5")


def test_flipped_frames_are_not_written_twice(spark, tmp_path):
    one = spark.createDataFrame([("u", 0, 2, 1, [1, 2])], "uuid string, frame_seq long, h int, w int, px array<int>")
    session_store.write_flipped(one, f"{tmp_path}/flipped")
    session_store.write_flipped(one.limit(0), f"{tmp_path}/flipped")
    assert [r["px"] for r in spark.read.parquet(f"{tmp_path}/flipped").collect()] == [[2, 1]]


def test_datasets_are_listed_without_a_name(spark):
    s = spark.createDataFrame([("u", "scalars/h", i, float(i)) for i in range(3)] + [("u", "other", 0, 1.0)], "uuid string, name string, frame_seq long, value double")
    assert {r["name"]: r["n_values"] for r in session_store.extract(s).collect()} == {"scalars/h": 3, "other": 1}


def test_reports_and_experiments(spark, tmp_path):
    rows = spark.createDataFrame([(10, 0.25), (2, 1 / 3)], "label int, jaccard double")
    tables.write_report(rows, f"{tmp_path}/report", label="label", value="jaccard", title="Similarity:")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/report").collect()] == ["Similarity:", "2: 0.3333", "10: 0.2500"]
    dense = tables.dense_matrix(spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.1)], "i int, j int, value double"), [0, 1])
    tables.write_matrix(dense, f"{tmp_path}/matrix", ["0", "1"])
    assert sorted([float(x) for x in r[0].split(" ")] for r in spark.read.text(f"{tmp_path}/matrix").collect()) == [[0.0, 0.5], [0.1, 0.0]]
    tables.write_csv(rows, f"{tmp_path}/features")
    for name, lines in (("good", ["a", "b"]), ("bad", ["a", "a"])):
        (tmp_path / f"{name}.csv").write_text("experiment_name,syllable_features_path\n" + "".join(f"{x},{tmp_path}/features\n" for x in lines))
    found = tables.read_experiments(spark, f"{tmp_path}/good.csv")
    assert sorted(found) == ["a", "b"] and found["a"].columns == ["label", "jaccard"]
    with pytest.raises(ValueError):
        tables.read_experiments(spark, f"{tmp_path}/bad.csv")


def test_sessions_need_as_many_frames(spark):
    a = spark.createDataFrame([("u", i) for i in range(3)], "uuid string, frame_seq long")
    b = a.unionByName(spark.createDataFrame([("other", 0)], "uuid string, frame_seq long"))
    similarity.check_same_frames(a, b)
    for less in (a.where("frame_seq > 0"), a.limit(0)):
        with pytest.raises(ValueError):
            similarity.check_same_frames(a, less)


def test_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, "a"), (1, 2, "b")], "`Unnamed: 0` int, `labels (original)` int, uuid string")
    tables.write_csv(rows, f"{tmp_path}/csv")
    back = tables.read_frames(spark, f"{tmp_path}/csv", format="csv")
    assert back.columns == ["label", "uuid"] and back.count() == 2
    assert tables.read_csv(spark, f"{tmp_path}/csv", index=True).columns == ["labels (original)", "uuid"]
    tables.write_yaml({"a": 1}, f"{tmp_path}/x.yaml")
    tables.write_yaml({"a": 2}, f"{tmp_path}/x.yaml")
    tables.write_yaml({"a": 3}, f"{tmp_path}/x.yaml")
    assert tables.read_yaml(f"{tmp_path}/x.yaml") == {"a": 3} and tables.read_yaml(f"{tmp_path}/x.yaml.bak") == {"a": 1}
    matrix = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.25)], "i int, j int, value double")
    assert [tuple(r) for r in tables.dense_matrix(matrix, [0, 1]).collect()] == [(0, 0.0, 0.5), (1, 0.25, 0.0)]
    tables.write_merge_map(spark.createDataFrame([(1, 2)], "old int, new int"), f"{tmp_path}/map")
    assert tables.read_csv(spark, f"{tmp_path}/map").columns == ["labels (original) - old", "labels (original) - new"]


def test_stream_assignment(spark, tmp_path):
    from seqlab.streaming.assign import append_to_library

    x, df = points(spark)
    df.drop("cluster").write.parquet(f"{tmp_path}/in")
    centroids = spark.createDataFrame([(k, x[k].tolist()) for k in range(3)], "cluster int, centroid array<double>")
    stream = spark.readStream.schema("id int, features array<double>").parquet(f"{tmp_path}/in")
    append_to_library(stream, centroids, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 30
