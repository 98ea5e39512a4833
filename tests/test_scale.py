"""Operators whose groups may be larger than a task: against NumPy and plain forms, with bounds set low."""

import math
import random
import subprocess
import sys
import textwrap

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqlab.operators import affinity, cluster, lloyd, normalize, plots, quantiles, silhouettes, similarity


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize(("few", "bins"), [(1, 2), (2, 7), (4096, 4096)])
def test_medians_by_numpy(spark, few, bins):
    rng = random.Random(few)
    groups = {
        "spread": [rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300) for _ in range(201)],
        "even": [rng.gauss(0, 1) for _ in range(100)],
        "ties": [float(rng.randint(-2, 2)) for _ in range(64)],
        "close": [1.0 + i * 2**-52 for i in range(30)],
        "signs": [-5e-324, 0.0, -0.0, 5e-324, -1.0, 1.0],
        "ends": [-1.7e308, 1.7e308, 1.6e308, -1.6e308, 1e308],
        "infinite": [float("-inf"), float("-inf"), 3.0, float("inf")],
        "nan": [1.0, float("nan"), float("nan")],
        "one": [7.5],
        None: [2.0, 9.0, None, 4.0],
        "null": [None, None],
    }
    rows = spark.createDataFrame([(k, x, "a", 0) for k, v in groups.items() for x in v], "g string, x double, n string, bin int").repartition(3)
    got = {r["g"]: (r["median"], r["n"]) for r in quantiles.exact_medians(rows, ["g"], "x", few=few, bins=bins).collect()}
    for k, v in groups.items():
        v = sorted((x for x in v if x is not None), key=lambda x: (math.isnan(x), x))
        if not v:
            assert k not in got
            continue
        a, b = v[(len(v) - 1) // 2], v[len(v) // 2]
        want = a if len(v) % 2 else 0.5 * a + 0.5 * b
        assert got[k][1] == len(v) and (got[k][0] == want or (math.isnan(want) and math.isnan(got[k][0]))), (k, got[k], want)
    assert quantiles.exact_medians(rows.where("false"), ["g"], "x").collect() == []
    whole = quantiles.exact_medians(rows.where("g = 'even'"), [], "x", few=few, bins=bins).collect()
    assert [r["median"] for r in whole] == [np.median(groups["even"])]


@pytest.mark.parametrize("few, bins", [(2, 2), (5, 16), (4096, 4096)])
def test_quantiles_by_numpy(spark, few, bins):
    rng = np.random.default_rng(3)
    groups = {"normal": rng.normal(size=401), "ties": rng.integers(0, 4, 300).astype(float), "wide": 10.0 ** rng.uniform(-300, 300, 200), "one": np.array([7.0]), None: -np.arange(10.0)}
    rows = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("none", None), ("one", None)], "g string, x double")
    probabilities = (0.0, 0.025, 0.25, 0.5, 0.75, 1.0, 0.25)
    got = quantiles.exact_quantiles(rows, ["g"], "x", probabilities=probabilities, few=few, bins=bins).collect()
    assert len(got) == len(groups) * 6
    for r in got:
        assert r["n"] == len(groups[r["g"]]) and r["quantile"] == pytest.approx(np.quantile(groups[r["g"]], r["probability"]), rel=1e-12, abs=1e-12)
    box = {r["g"]: r for r in plots.box_quantiles(rows, "x", ["g"]).collect()}
    assert (box["ties"]["low"], box["ties"]["high"], box[None]["q1"]) == (0.0, 3.0, -6.75)
    with pytest.raises(ValueError, match="between 0 and 1"):
        quantiles.exact_quantiles(rows, ["g"], "x", probabilities=(1.5,))


def test_medians_of_ten_million_values_in_little_memory():
    """One group of 10 million distinct doubles, with a driver of 1 GB and no buffer of its values."""
    code = """
        from pyspark.sql import SparkSession, functions as F
        from seqlab.operators import quantiles
        import tempfile
        spark = (SparkSession.builder.master("local[4]").config("spark.driver.memory", "1g").config("spark.ui.enabled", "false")
                 .config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp()).getOrCreate())
        n = 10_000_001
        rows = spark.range(n).select(F.lit("g").alias("g"), F.sqrt((F.col("id") * 7_368_787) % n).alias("x"))
        r = quantiles.exact_medians(rows, ["g"], "x").first()
        assert (r["n"], r["median"]) == (n, (n // 2) ** 0.5), r
        print("right")
    """
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=600)
    assert out.stdout.strip().endswith("right"), out.stderr[-2000:]


@pytest.mark.parametrize("scope", ["column", "global"])
@pytest.mark.parametrize("by", [["e"], []])
def test_robust_zscore_in_passes(spark, scope, by):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 2)) * [1, 50]
    rows = spark.createDataFrame([("ab"[i % 2] if i else None, float(a), None if i == 9 else float(b), i) for i, (a, b) in enumerate(x)], "e string, a double, median double, n int")
    got = {r["n"]: (r["z_a"], r["z_median"]) for r in normalize.robust_zscore(rows, ["a", "median"], by=by, mad_scope=scope, few=2).collect()}
    assert len(got) == 60 and got[9][1] is None
    for part in ([0], range(1, 60, 2), range(2, 60, 2)) if by else (range(60),):
        mine = x[list(part)].copy()
        if 9 in part:
            mine[list(part).index(9), 1] = np.nan
        gap = mine - np.nanmedian(mine, axis=0)
        mad = np.nanmedian(np.abs(gap), axis=0) if scope == "column" else np.full(2, np.nanmedian(np.abs(gap)))
        for i, g in zip(part, gap, strict=True):
            for z, d, m in zip(got[i], g, mad, strict=True):
                assert z is None if np.isnan(d) or m == 0 else z == pytest.approx(d / (1.4826 * m))


def test_subject_distances_are_means_over_pairs(spark):
    rng = random.Random(5)
    side = lambda names, dims: [(g, f"{g}{s}", d, rng.random()) for g in names for s in range(4) for d in rng.sample(dims, 3)]
    left = [*side("ab", range(6)), ("b", "zero", 1, 0.0), ("c", "apart", 99, 1.0), ("c", "apart", None, 0.5), (None, "n", 2, 1.0)]
    right = [*side("ab", range(6)), ("a", "zero", 3, 0.0), ("empty", "zero", 3, 0.0), ("d", "x", 77, 2.0)]
    schema = "group string, uuid string, syllable int, usage double"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    out = similarity.subject_distances(a, b)
    got = {(r["group1"], r["group2"], r["uuid"]): r["cosine_distance"] for r in out.collect()}

    def vectors(rows):
        found = {}
        for g, s, d, x in rows:
            found.setdefault((g, s), {})[d] = x
        return found

    def cosine(v, w):
        n = math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in w.values()))
        return 1 - sum(x * w.get(d, 0) for d, x in v.items()) / n if n else None

    va, vb = vectors(left), vectors(right)
    assert set(got) == {(g, h, s) for g, s in va for h, _ in vb}
    for (g, s), v in va.items():
        for h in {h for h, _ in vb}:
            d = [x for x in (cosine(v, w) for (k, _), w in vb.items() if k == h) if x is not None]
            want = sum(d) / len(d) if d else None
            assert got[g, h, s] == (pytest.approx(want) if want is not None else None), (g, h, s)
    assert "NestedLoop" not in plan_of(out) and "Cartesian" not in plan_of(out)
    assert similarity.subject_distances(a.where("false"), b).collect() == []
    assert out.where(F.col("uuid") == "zero").select("cosine_distance").distinct().collect()[0][0] is None


def numpy_silhouettes(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i, own in enumerate(labels):
        mine = labels == own
        others = [d[i, labels == c].mean() for c in set(labels) if c != own]
        a = d[i, mine].sum() / max(1, mine.sum() - 1)
        b = min(others, default=0)
        out.append((b - a) / max(a, b) if mine.sum() > 1 and others and max(a, b) > 0 else 0.0)
    return np.array(out)


@pytest.mark.parametrize("block", [1, 7, 2048])
def test_silhouettes_of_many_clusterings(spark, block, monkeypatch):
    rng = np.random.default_rng(block)
    x = np.concatenate([rng.normal(size=(40, 3)), np.zeros((6, 3))])
    labels = np.column_stack([rng.integers(0, k, 46) for k in (1, 2, 9)] + [np.arange(46), np.repeat([0, 12], 23)])
    names = [f"c{i}" for i in range(labels.shape[1])]
    rows = [(i, v.tolist(), *c.tolist()) for i, (v, c) in enumerate(zip(x, labels, strict=True))] + [(90, None, *[0] * 5), (91, [0.0] * 3, None, *[0] * 4)]
    df = spark.createDataFrame(rows, "id int, features array<double>, " + ", ".join(f"{c} int" for c in names)).repartition(2)
    got = {int(r["key"]): r["silhouettes"] for r in silhouettes.silhouette_samples(df, names, block=block).collect()}
    want = np.column_stack([numpy_silhouettes(x, c) for c in labels.T])
    assert set(got) == set(range(46)) and np.allclose([got[i] for i in range(46)], want)
    curve = {r["k"]: (r["silhouette"], r["best"]) for r in silhouettes.silhouette_curve(df.where("id < 90"), {10 - i: c for i, c in enumerate(names)}, block=block).collect()}
    means = {10 - i: m for i, m in enumerate(want.mean(axis=0))}
    assert all(curve[k][0] == pytest.approx(m) for k, m in means.items())
    assert [k for k, (_, best) in curve.items() if best] == [min(means, key=lambda k: (-round(means[k], 12), k))]
    assert silhouettes.silhouette_samples(df.where("false"), names).collect() == []


def test_distances_are_computed_once_for_all_k(spark, monkeypatch):
    """The pass over blocks is one job whatever the number of k; more clusters only make blocks smaller."""
    x = np.random.default_rng(1).normal(size=(60, 2)) + np.repeat([[0, 0], [20, 0], [0, 20]], 20, axis=0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, features array<double>")
    calls = []
    real = silhouettes._go_through
    monkeypatch.setattr(silhouettes, "_go_through", lambda dims, tops: calls.append(len(tops)) or real(dims, tops))
    curve = cluster.choose_k(df, least=2, most=8, step=1).collect()
    assert calls == [6] and curve[0]["k"] == 3 and curve[0]["silhouette"] > 0.8
    own = np.repeat([0, 1, 2], 20)  # three groups far apart: the fit of 3 is no matter of seeds
    assert curve[0]["silhouette"] == pytest.approx(numpy_silhouettes(x, own).mean())


def far_apart(rng):
    """Vectors of 6 components far from zero, with copies, near copies, and two that are no finite numbers."""
    x = np.repeat(rng.normal(size=(12, 6)) + 1e6, 5, axis=0)
    x[1::5] += rng.normal(size=(12, 6)) * 1e-7
    x[2::5] += rng.normal(size=(12, 6))
    x[[7, 33], [0, 3]] = math.inf, math.nan
    return x


@pytest.mark.parametrize("clusters", [5, 40])
@pytest.mark.parametrize(("block", "company"), [(60, 32), (7, 1), (6, 2)])
def test_silhouettes_far_from_zero(spark, clusters, block, company, monkeypatch):
    """Products of centred vectors lose nothing that differences keep, in short sums and in long ones."""
    monkeypatch.setattr(silhouettes, "COMPANY", company, raising=False)
    rng = np.random.default_rng(block)
    x = far_apart(rng)
    labels = np.append(np.arange(59) // 5 % clusters, clusters - 1)
    bad = ~np.isfinite(x).all(axis=1)
    gap = np.where(bad[:, None], 0.0, x)
    d = np.sqrt(((gap[:, None] - gap[None]) ** 2).sum(axis=2))
    d[bad], d[:, bad] = math.inf, math.inf
    want = []
    for i, own in enumerate(labels):
        n = (labels == own).sum()
        a = np.delete(d[i], i)[np.delete(labels, i) == own].sum() / max(1, n - 1)
        b = min(d[i, labels == c].mean() for c in set(labels) if c != own)
        want.append((b - a) / max(a, b) if n > 1 and math.isfinite(a) and math.isfinite(b) and max(a, b) > 0 else 0.0)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels, strict=True))], "id int, features array<double>, c int")
    got = {int(r["key"]): r["silhouettes"][0] for r in silhouettes.silhouette_samples(df, ["c"], block=block).collect()}
    assert np.count_nonzero(want) > 20 and np.allclose([got[i] for i in range(60)], want, rtol=1e-12, atol=1e-12)


def meetings(spark, monkeypatch, folder, of):
    """Blocks that came to the tasks of a pass over 40 points in at most 10 blocks."""
    real = silhouettes._go_through

    def counted(dims, tops):
        def go(batches):
            found = list(batches)
            if found:
                (folder / str(random.SystemRandom().random())).write_text(str(sum(b.num_rows for b in found)))
            yield from real(dims, tops)(iter(found))

        return go

    monkeypatch.setattr(silhouettes, "_go_through", counted)
    x = np.random.default_rng(4).normal(size=(40, 3))
    of(spark.createDataFrame([(i, v.tolist(), i % 2, i % 3) for i, v in enumerate(x)], "id int, features array<double>, k2 int, k3 int")).collect()
    return sum(int(p.read_text()) for p in folder.iterdir())


def test_two_blocks_meet_once(spark, monkeypatch, tmp_path):
    assert 40 < meetings(spark, monkeypatch, tmp_path, lambda df: silhouettes.silhouette_samples(df, ["k3"], block=4)) <= 10 + 45


def test_a_curve_takes_one_pass(spark, monkeypatch, tmp_path):
    assert 40 < meetings(spark, monkeypatch, tmp_path, lambda df: silhouettes.silhouette_curve(df, {2: "k2", 3: "k3"}, block=4)) <= 10 + 45


def test_sums_of_clusterings_are_made_by_class(monkeypatch):
    """Four clusterings of ten labels have 17 clusters, but distances are added up by the ten labels; both blocks get the sums of all clusters."""
    rng = np.random.default_rng(8)
    ks, tops = (2, 3, 5, 7), (1, 2, 4, 6)

    def block(n):
        x, labels = rng.normal(size=(n, 5)), np.arange(n) * 7 % 10
        labels = np.column_stack([labels % k for k in ks]).astype("<i4")
        places = np.append(np.arange(n - 2), [0, 0]).astype("<i4")  # three points of one vector
        row = {"x": x[: n - 2].tobytes(), "places": places.tobytes(), "labels": labels.tobytes()}
        return silhouettes._Points(row, 5, tops), x[places], np.concatenate([np.equal.outer(c, np.arange(k)) for c, k in zip(labels.T, ks, strict=True)], axis=1).astype(float)

    widths = []
    real = silhouettes._Points.weights
    monkeypatch.setattr(silhouettes._Points, "weights", lambda self: widths.append(real(self)) or widths[-1])
    (own, x, a), (other, y, b) = block(300), block(1100)
    sums = silhouettes._Sums(own, True)
    back = sums.add(other)
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    assert [np.shape(w[0])[1:] for w in widths] == [(10,), (10,)]
    assert np.allclose(sums.totals[own.places], d @ b, rtol=1e-12) and np.allclose(back[other.places], d.T @ a, rtol=1e-12)


@pytest.mark.parametrize("bounds", [{}, {"block": 3, "max_bytes": 200}])
def test_pruned_lloyd_equals_plain_steps(spark, bounds):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 3)) * 10
    x = np.concatenate([middle[i % 12] + rng.normal(size=3) for i in range(400)]).reshape(-1, 3).round(2)
    points = spark.createDataFrame([(i, v.tolist(), 7, "a") for i, v in enumerate(x)] + [(0, x[0].tolist(), 7, "again"), (900, None, 7, "none")], "id int, features array<double>, cluster int, row string").repartition(3)
    start = [*x[:12], x[3], np.full(3, 1e3)]  # a centroid twice, and one that no point goes to
    centroids = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(start)], "cluster int, centroid array<double>")
    usable = points.where("features IS NOT NULL")
    plain = centroids
    for _ in range(5):
        step = cluster.lloyd_step(usable, plain)
        plain = spark.createDataFrame(step.collect(), step.schema)
    out, got, report = lloyd.pruned_lloyd(points, centroids, rounds=5, **bounds)
    want = {r["cluster"]: r["centroid"] for r in plain.collect()}
    mine = {r["cluster"]: r["centroid"] for r in got.collect()}
    assert set(mine) == set(want) and all(np.allclose(mine[c], want[c], atol=1e-9) for c in want)
    key = lambda df: sorted((r["id"], r["row"], r["cluster"], round(r["distance"], 6)) for r in df.collect())
    assert key(out) == key(cluster.assign(usable, got)) and len(key(out)) == 401
    told = report.orderBy("round").collect()
    assert [r["round"] for r in told] == list(range(6)) and all(r["n_kept"] + r["n_own"] + r["n_scanned"] == 401 for r in told)
    assert told[0]["share"] == 1 and told[-1]["share"] < 0.5  # few are compared with all


def test_fifty_thousand_centroids(spark):
    rng = np.random.default_rng(5)
    c = rng.normal(size=(50_000, 8))
    x = np.concatenate([c[rng.integers(0, 50_000, 300)] + 0.01 * rng.normal(size=(300, 8)), c[:20]])
    centroids = spark.createDataFrame(pd.DataFrame({"cluster": np.arange(50_000, dtype="int32"), "centroid": c.tolist()}))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, features array<double>")
    found = {r["id"]: (r["cluster"], r["distance"]) for r in cluster.assign(points, centroids).collect()}
    for i, v in enumerate(x):
        d2 = ((c - v) ** 2).sum(axis=1)
        assert found[i][0] == d2.argmin() and found[i][1] == pytest.approx(math.sqrt(d2.min()), abs=1e-4)
    _, _, report = lloyd.pruned_lloyd(points, centroids, rounds=1, max_bytes=1 << 20)  # four passes
    last = report.orderBy("round").collect()[-1]
    assert last["n_points"] == 320 and last["share"] < 1


def test_poisson_bootstrap(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(3, 2, size=400)
    rows = spark.createDataFrame([(i, "ab"[i % 2], float(v), None if i % 2 else float(i), 0) for i, v in enumerate(x)] + [(900, None, 1.0, None, 0), (901, "c", None, None, 0)], "id long, g string, x double, y double, _r int")
    found = {(r["g"], r["metric"]): r for r in plots.bootstrap_bands(rows, ["x", "y"], ["g"], key="id", replicates=400).collect()}
    assert set(found) == {(g, m) for g in ("a", "b", "c", None) for m in "xy"}
    for i, g in enumerate("ab"):
        mine, r = x[i::2], found[g, "x"]
        half = 1.96 * mine.std() / math.sqrt(len(mine))
        assert r["n"] == 200 and r["mean"] == pytest.approx(mine.mean())
        assert r["mean"] - r["low"] == pytest.approx(half, rel=0.25) and r["high"] - r["mean"] == pytest.approx(half, rel=0.25)
    assert found["a", "y"]["n"] == 200 and [found["b", "y"][c] for c in ("n", "mean", "low", "high")] == [0, None, None, None]
    assert found["c", "x"]["mean"] is None and found[None, "x"]["low"] in (1.0, None)
    again = {(r["g"], r["metric"]): r for r in plots.bootstrap_bands(rows.repartition(7), ["x", "y"], ["g"], key="id", replicates=400).collect()}
    assert all(again[k]["low"] == pytest.approx(r["low"]) if r["low"] is not None else again[k]["low"] is None for k, r in found.items())
    pairs = spark.range(20_000).select("id", F.lit(5).alias("r"), F.lit(6).alias("s"))
    w = plots.with_poisson_weight(plots.with_poisson_weight(pairs, "id", "r", "w"), "id", "s", "v").toPandas()
    assert abs(w["w"].mean() - 1) < 0.03 and abs(w["w"].var() - 1) < 0.05 and abs(w["w"].corr(w["v"])) < 0.03
    assert abs((w["w"] == 0).mean() - math.exp(-1)) < 0.01


def test_session_sets(spark):
    made = lambda v: spark.createDataFrame([(x,) for x in v], "uuid string")
    a, b = made(["x", "y", "y", None]), made(["y", None, "x", "x"])
    assert similarity.session_differences(a, b).collect() == [] and "Join" not in plan_of(similarity.session_differences(a, b))
    similarity.check_same_sessions(a, b)
    with pytest.raises(ValueError, match="z is in the second"):
        similarity.check_same_sessions(a, made(["x", "y", "z", None]))
    assert [tuple(r) for r in similarity.session_differences(a, made([])).orderBy("uuid").collect()] == [(None, True, False), ("x", True, False), ("y", True, False)]


@pytest.mark.parametrize(("n", "block_bytes"), [(37, 8 * 37 * 5), (2, 1), (1, 1)])
def test_affinity_by_blocks_equals_one_matrix(spark, n, block_bytes):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 2)) + rng.integers(0, 3, n)[:, None] * 6
    df = spark.createDataFrame([(f"p{i:02d}", v.tolist(), i) for i, v in enumerate(x)] + [("none", None, 0)], "id string, features array<double>, cluster int")
    got = {r["id"]: (r["cluster"], r["exemplar"]) for r in affinity.propagate(df, block_bytes=block_bytes, max_iter=25, stable=6).collect()}
    want = {r["id"]: (r["cluster"], r["exemplar"]) for r in cluster.affinity_propagation(df.where("id <> 'none'"), max_iter=25, stable=6).collect()}
    assert got == want and len(got) == n
    assert affinity.propagate(df.where("false")).collect() == []
