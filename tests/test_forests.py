"""Classifiers as tables equal the models that they were taken from."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler

from seqlab.operators import cluster, forests


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4)) * [1, 10, 0.1, 0] + [0, 5, 0, 3]  # the last column is constant
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 9)
    return spark.createDataFrame([(i, *v.tolist(), float(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, c double, d double, label double").cache()


@pytest.mark.parametrize("kind", ["forest", "tree"])
def test_bundle_equals_its_model(spark, rows, kind, tmp_path):
    last = RandomForestClassifier(numTrees=7, maxDepth=4, seed=1, featuresCol="s") if kind == "forest" else DecisionTreeClassifier(maxDepth=3, featuresCol="s")
    columns = ["a", "b", "c", "d"]
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="v"), StandardScaler(withMean=True, inputCol="v", outputCol="s"), last]).fit(rows)
    forests.bundle_of(model, columns).save(f"{tmp_path}/bundle")
    bundle = forests.TreeBundle.load(spark, f"{tmp_path}/bundle")
    want = {r["id"]: (r["prediction"], r["probability"].toArray()) for r in model.transform(rows).collect()}
    got = {r["id"]: (r["prediction"], r["probability"]) for r in bundle.transform(rows).collect()}
    assert set(got) == set(want) and all(got[i][0] == p and np.allclose(got[i][1], q) for i, (p, q) in want.items())
    assert len({p for p, _ in got.values()}) == 3
    both = cluster.apply_classifiers(rows, {"syllable_quality": bundle, "model": model}, columns)
    assert both.where("syllable_quality <> model").isEmpty() and both.columns == [*rows.columns, "syllable_quality", "model"]


def test_bundle_edges(spark):
    inputs = spark.createDataFrame([(0, "x", 0.0, 2.0)], forests.INPUTS)
    nodes = spark.createDataFrame([(0, 0, 0, 1.0, 1, 2, 1.0, [1.0, 1.0]), (0, 1, -1, 0.0, -1, -1, 1.0, [2.0, 2.0]), (0, 2, -1, 0.0, -1, -1, 1.0, [0.0, 5.0]), (3, 0, -1, 0.0, -1, -1, 0.5, [1.0, 0.0])], forests.NODES)
    rows = spark.createDataFrame([(1, 2.0, "a"), (2, 2.5, "a"), (3, None, "a"), (4, float("nan"), "a")], "id int, x double, node string")
    got = {r["id"]: (r["prediction"], r["probability"]) for r in forests.TreeBundle(inputs, nodes).transform(rows).collect()}
    assert got[1] == (0.0, [pytest.approx(2 / 3), pytest.approx(1 / 3)]) and got[2] == (1.0, [pytest.approx(1 / 3), pytest.approx(2 / 3)])
    assert got[3] == (None, None) and got[4] == got[2]
    assert forests.TreeBundle(inputs, nodes).transform(rows.where("false")).collect() == []
    none = forests.TreeBundle(inputs, nodes.where("false")).transform(rows).collect()
    assert len(none) == 4 and all(r["prediction"] is None for r in none)
