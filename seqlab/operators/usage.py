"""Label usage, pivots, relabelling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_usage(frames: DataFrame, *, label: str = "label", onset: str | None = "onset", by: Sequence[str] = ()) -> DataFrame:
    """n and usage (share of rows) of each label, within ``by`` (A6, A8); only onset rows unless ``onset`` is None.

    Counts first: the total is a sum over labels, not over frames.
    """
    rows = frames.where(F.col(onset)) if onset else frames
    n = rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    if by:
        return n.withColumn("usage", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
    total = n.agg(F.sum("n").alias("_total"))
    return n.join(F.broadcast(total)).withColumn("usage", F.col("n") / F.col("_total")).drop("_total")


def group_usage_stats(frames: DataFrame, metrics: Sequence[str], *, group: str = "group", session: str = "uuid", label: str = "label", onset: str = "onset") -> DataFrame:
    """Per (group, session, label): onsets, usage within the session, mean of each metric."""
    stats = frames.where(F.col(onset)).groupBy(group, session, label).agg(F.count(F.lit(1)).alias("n"), *(F.avg(m).alias(f"avg_{m}") for m in metrics))
    return stats.withColumn("usage", F.col("n") / F.sum("n").over(Window.partitionBy(group, session)))


def group_mean_usage(stats: DataFrame, *, threshold: float = 0.005, group: str = "group", label: str = "syllable") -> DataFrame:
    """Mean usage per group and label of rows with usage > threshold (F1, A1): subjects below it don't count."""
    return stats.where(F.col("usage") > threshold).groupBy(group, label).agg(F.avg("usage").alias("usage"))


def usage_pivot(stats: DataFrame, labels: Sequence, *, rows: Sequence[str] = ("group",), label: str = "syllable", prefix: str = "") -> DataFrame:
    """Mean usage, labels as columns, 0 where there is none (A2, A3). ``labels`` fixes the columns, so that no extra pass finds them."""
    wide = stats.groupBy(*rows).pivot(label, list(labels)).agg(F.avg("usage")).na.fill(0.0)
    return wide.select(*rows, *(F.col(f"`{x}`").alias(f"{prefix}{x}") for x in labels))


def relabel(frames: DataFrame, merge_map: DataFrame, *, label: str = "label", old: str = "old", new: str = "new") -> DataFrame:
    """Adds ``new_label``: one pass over the map, so 1->2, 2->3 takes 1 to 2; labels not in it stay.

    Of repeated old labels the largest new one counts. The map has a row per
    label, so it is left to Spark to broadcast it.
    """
    single = merge_map.groupBy(F.col(old).alias("_old")).agg(F.max(new).alias("_new"))
    met = frames.join(single, frames[label] == single["_old"], "left")
    return met.withColumn("new_label", F.coalesce("_new", F.col(label))).drop("_old", "_new")


def label_map(frames: DataFrame, source: str, target: str) -> DataFrame:
    """Distinct (source, target) pairs (J11); raises if a source has two targets."""
    pairs = frames.select(source, target).distinct()
    twice = pairs.groupBy(source).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if twice:
        raise ValueError(f"{source} does not determine {target}")
    return pairs


def percent_equal(frames: DataFrame, a: str, b: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Percentage of rows where two columns are equal."""
    return frames.groupBy(*by).agg((100 * F.avg(F.col(a).eqNullSafe(F.col(b)).cast("double"))).alias("percent_equal"))


def merge_directions(pairs: DataFrame, usage: DataFrame, *, i: str = "syll_i", j: str = "syll_j", label: str = "label") -> DataFrame:
    """Joins both usages and names the label to keep (X8, J4): the less used goes into the more used; ties and missing usage go into j."""
    u = usage.select(F.col(label).alias("_label"), "usage")
    met = pairs.join(u.select(F.col("_label").alias(i), F.col("usage").alias("usage_i")), i, "left").join(u.select(F.col("_label").alias(j), F.col("usage").alias("usage_j")), j, "left")
    to_i = F.col("usage_i") > F.col("usage_j")
    return met.withColumn("merge_into", F.when(to_i, F.col(i)).otherwise(F.col(j))).withColumn("to_merge", F.when(to_i, F.col(j)).otherwise(F.col(i)))


def merge_log(merge_map: DataFrame, usage: DataFrame, *, old: str = "old", new: str = "new", label: str = "label") -> DataFrame:
    """Lines that say which label goes into which, with both usages."""
    u = usage.select(F.col(label).alias("_label"), "usage")
    met = merge_map.join(u.withColumnsRenamed({"_label": old, "usage": "usage_old"}), old, "left").join(u.withColumnsRenamed({"_label": new, "usage": "usage_new"}), new, "left")
    line = F.format_string("%s (%.3f) -> %s (%.3f)", F.col(old).cast("string"), F.coalesce("usage_old", F.lit(0.0)), F.col(new).cast("string"), F.coalesce("usage_new", F.lit(0.0)))
    return met.select(old, new, line.alias("line"))
