"""Classifiers as tables (C9): a scaler and the nodes of trees, scored without unpickling anything.

A bundle is two tables. ``inputs``: position (from 0), column, shift, scale - a
feature is (column - shift) / scale. ``nodes``: tree, node (from 0, the root),
feature, threshold (a value at most that goes left), left and right (-1 in a
leaf), weight of the tree, votes of each class. A row goes down all trees at
once in JVM expressions; the tables are one row of bounded size beside it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.sources.scratch import new_path

INPUTS = "position int, column string, shift double, scale double"
NODES = "tree int, node int, feature int, threshold double, left int, right int, weight double, votes array<double>"

#: Nodes of all trees that may stand beside each row.
MOST_NODES = 1 << 20


@dataclass
class TreeBundle:
    """A fitted classifier of trees: ``transform`` adds ``probability`` (a share of votes for each class) and ``prediction`` (the first class of most)."""

    inputs: DataFrame
    nodes: DataFrame

    def save(self, path: str) -> None:
        for name in ("inputs", "nodes"):
            getattr(self, name).write.mode("error").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeBundle:
        return cls(spark.read.parquet(f"{path}/inputs"), spark.read.parquet(f"{path}/nodes"))

    def transform(self, rows: DataFrame, *, prediction: str = "prediction", probability: str = "probability") -> DataFrame:
        """Rows with a null feature, and a bundle without trees, have a null prediction; NaN is above every threshold.

        The inputs are a row a feature and go through the driver, as columns of
        an expression do; the nodes are counted before they are broadcast.
        """
        inputs = self.inputs.orderBy("position").collect()
        n = self.nodes.count()
        if n > MOST_NODES:
            raise ValueError(f"{n} nodes are more than {MOST_NODES}")
        feature = lambda r: (F.col(f"`{r['column']}`").cast("double") - r["shift"]) / r["scale"]
        x = F.array(*map(feature, inputs)) if inputs else F.array().cast("array<double>")
        tree = F.struct("tree", F.max("weight").alias("weight"), F.array_sort(F.collect_list(F.struct("node", "feature", "threshold", "left", "right", "votes"))).alias("nodes"))
        trees = self.nodes.groupBy("tree").agg(tree.alias("t")).agg(F.array_sort(F.collect_list("t")).alias("_trees"))
        steps = F.sequence(F.lit(1), F.lit(max(1, _depth(self.nodes))))

        def leaf(t: Column) -> Column:
            at = lambda i: F.get(t["nodes"], i)
            down = lambda i, _: F.when(at(i)["left"] < 0, i).when(F.get("_x", at(i)["feature"]) <= at(i)["threshold"], at(i)["left"]).otherwise(at(i)["right"])
            return at(F.aggregate(steps, F.lit(0), down))

        def share(t: Column) -> Column:
            votes = leaf(t)["votes"]
            total = F.aggregate(votes, F.lit(0.0), lambda a, v: a + v)
            return F.transform(votes, lambda v: F.try_divide(v * t["weight"], total))

        known = F.col("_x").isNotNull() & ~F.exists("_x", lambda v: v.isNull())
        met = rows.withColumn("_x", x).join(F.broadcast(trees)).withColumn("_s", F.when(known, F.transform("_trees", share)))
        added = lambda a, b: F.when(F.size(a) == 0, b).otherwise(F.zip_with(a, b, lambda v, w: v + w))
        met = met.withColumn("_v", F.aggregate("_s", F.array().cast("array<double>"), added))
        total = F.aggregate("_v", F.lit(0.0), lambda a, v: a + v)
        best = F.when(F.size("_v") > 0, F.array_position("_v", F.array_max("_v")) - 1).cast("double")
        return met.select(*rows.columns, F.transform("_v", lambda v: F.try_divide(v, total)).alias(probability), best.alias(prediction))


def _depth(nodes: DataFrame) -> int:
    """Steps from a root to the farthest leaf: the levels of the trees, one join each."""
    level, depth = nodes.where("node = 0 AND left >= 0").select("tree", "left", "right"), 0
    while not level.isEmpty():
        depth += 1
        below = level.select("tree", F.explode(F.array("left", "right")).alias("node"))
        level = nodes.where("left >= 0").join(below, ["tree", "node"]).select("tree", "left", "right")
    return depth


def bundle_of(model: PipelineModel, columns: Sequence[str]) -> TreeBundle:
    """The tables of a fitted Spark ML pipeline: an assembler of ``columns``, a standard scaler if there is one, and a decision tree or random forest classifier.

    Nodes are read from the model as Spark itself saves it, which is Parquet.
    """
    spark = SparkSession.getActiveSession()
    shift, scale = [0.0] * len(columns), [1.0] * len(columns)
    for stage in model.stages:
        if type(stage).__name__ == "StandardScalerModel":
            if stage.getWithMean():
                shift = stage.mean.toArray().tolist()
            if stage.getWithStd():
                scale = [s or float("inf") for s in stage.std.toArray().tolist()]  # a constant column becomes 0
    inputs = spark.createDataFrame([(i, c, a, b) for i, (c, a, b) in enumerate(zip(columns, shift, scale, strict=True))], INPUTS)
    path = new_path(spark, "classifier")
    model.stages[-1].write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "treeID" in data.columns:
        weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "_metadata", "weight").select(F.col("tree").cast("int").alias("tree"), F.col("weight").cast("double").alias("weight"))
        data = data.select(F.col("treeID").cast("int").alias("tree"), "nodeData.*").join(weights, "tree")
    else:
        data = data.select(F.lit(0).alias("tree"), "*", F.lit(1.0).alias("weight"))
    if not data.where("split.numCategories > 0").isEmpty():
        raise ValueError("splits by category have no threshold")
    nodes = data.select("tree", F.col("id").alias("node"), F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), "weight", F.col("impurityStats").alias("votes"))
    return TreeBundle(inputs, nodes)
