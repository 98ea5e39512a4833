"""Queries that use all rows and all components, against NumPy on small tables."""

from pathlib import Path

import numpy as np
import pytest

from seqlab.operators import treatments
from seqlab.plans.catalog import QUERIES


def embeddings(spark, folder, ids, n=64, seed=0):
    """A folder with an embeddings table of the ids; and its vectors as doubles."""
    x = np.random.default_rng(seed).normal(size=(len(ids), n)).astype(np.float32)
    rows = [(i, i % 3, v.tolist()) for i, v in zip(ids, x, strict=True)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return x.astype(float)


def test_ar_eigen_uses_every_whole_group(spark, tmp_path):
    x = embeddings(spark, tmp_path, range(50))  # twelve groups, and two rows of a thirteenth
    got = {r["label"]: r for r in QUERIES["ar_eigen"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(12))
    for label, r in got.items():
        companion = np.vstack([x[4 * label : 4 * label + 4, :12], np.eye(12)[:8]])
        m = np.sort(np.abs(np.linalg.eigvalsh(companion)))[::-1]
        assert r["spectral_radius"] == pytest.approx(m[0])
        assert [r[f"eigval_{i}"] for i in range(1, 11)] == pytest.approx(m[:10])
        assert r["dynamic_complexity"] == pytest.approx(-sum(p * np.log(p + 1e-10) for p in m / m.sum()))


def test_groups_by_suffix_takes_the_first_path_that_ends_in_the_name(spark):
    targets = ["/t/825", "/t/x.h5/", "/t/y.h5/.", "/", "/t/none", None]
    sources = [("/s/1825", "a", 1), ("/s/825", "b", 2), ("/s/z/", "c", 0), ("/s/box.h5", "d", 5), ("/s/x.h5", "e", 6), ("/s/y.h5", None, 7), (None, "f", -1)]
    target = spark.createDataFrame([(x,) for x in targets], "path string")
    source = spark.createDataFrame(sources, "path string, group string, position int")
    got = {r["path"]: (r["source_group"], r["found"]) for r in treatments.groups_by_suffix(target, source).collect()}
    want = {None: (None, False)}
    for path in targets[:-1]:
        ends = [(at, group) for p, group, at in sources if p is not None and p.endswith(Path(path).name)]
        want[path] = (min(ends)[1], True) if ends else (None, False)
    assert got == want
    assert got["/t/825"] == ("a", True) and got["/"] == ("c", True) and got["/t/y.h5/."] == (None, True)


def test_l2_normalize_whole_keeps_every_component(spark, tmp_path):
    x = embeddings(spark, tmp_path, range(7))
    got = {(r["id"], r["dim"]): r["x"] for r in QUERIES["l2_normalize_whole"](spark, str(tmp_path)).collect()}
    want = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert sorted(got) == [(i, d) for i in range(7) for d in range(64)]
    assert [got[i, d] for i in range(7) for d in range(64)] == pytest.approx(want.ravel().tolist(), abs=1e-6)


def test_pc_zscore_all_scales_ten_components(spark, tmp_path):
    x = embeddings(spark, tmp_path, range(9))[:, :10]
    want = (x - x.mean(axis=0)) / x.std(axis=0)
    rows = sorted(QUERIES["pc_zscore_all"](spark, str(tmp_path)).collect(), key=lambda r: r["id"])
    assert len(rows) == 9
    for r, z in zip(rows, want, strict=True):
        assert [r[f"z_pc_{i}"] for i in range(1, 11)] == pytest.approx(z.tolist(), abs=1e-6)
