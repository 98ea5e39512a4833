"""Label resamples: redundant labels from their confusion across resamples.

Rows are (frame, resample, label); a frame's rows meet on the frame key, and
counts stay sparse, so that there is no cap on labels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid_frames(resamples: DataFrame, *, frame: Sequence[str] = ("frame",), label: str = "label") -> DataFrame:
    """Rows of frames whose labels are all >= 0 (F10); one exchange on the frame."""
    least = F.min(label).over(Window.partitionBy(*frame))
    return resamples.withColumn("_least", least).where(F.col("_least") >= 0).drop("_least")


def transition_entropy(resamples: DataFrame, *, frame: Sequence[str] = ("frame",), resample: Sequence[str] = ("resample",), label: str = "label") -> DataFrame:
    """Per frame: rate of label changes between consecutive resamples (W15) and its Bernoulli entropy, natural log (W16). A rate of 0 or 1 has entropy 0."""
    order = Window.partitionBy(*frame).orderBy(*resample)
    changed = resamples.withColumn("_changed", (F.col(label) != F.lag(label).over(order)).cast("int"))
    out = changed.groupBy(*frame).agg(F.sum("_changed").alias("n_changes"), F.count("_changed").alias("n_steps"))
    p = F.try_divide(F.col("n_changes"), F.col("n_steps"))
    inside = (F.col("n_changes") > 0) & (F.col("n_changes") < F.col("n_steps"))
    q = F.col("rate")
    out = out.withColumn("rate", p)
    return out.withColumn("entropy", F.when(inside, -(q * F.ln(F.when(inside, q)) + (1 - q) * F.ln(F.when(inside, 1 - q)))).otherwise(0.0))


def stable_frames(entropies: DataFrame, *, session: Sequence[str] = ("uuid",), order: Sequence[str] = ("frame",), threshold: float = 0.25) -> DataFrame:
    """Frames where the larger entropy of it and of the frame before is below the threshold."""
    pair = Window.partitionBy(*session).orderBy(*order).rowsBetween(-1, 0)
    return entropies.withColumn("_near", F.max("entropy").over(pair)).where(F.col("_near") < threshold).drop("_near")


def top_labels(resamples: DataFrame, *, k: int = 2, frame: Sequence[str] = ("frame",), label: str = "label") -> DataFrame:
    """The k most frequent labels per frame (A15, W17) with their share among them (W18): frame, label, n, rank, share. Ties go to the larger label."""
    n = resamples.groupBy(*frame, label).agg(F.count(F.lit(1)).alias("n"))
    ranked = n.withColumn("rank", F.row_number().over(Window.partitionBy(*frame).orderBy(F.desc("n"), F.desc(label)))).where(F.col("rank") <= k)
    return ranked.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*frame)))


def occupancy(top: DataFrame, *, label: str = "label") -> DataFrame:
    """Sum of shares per label."""
    return top.groupBy(label).agg(F.sum("share").alias("occupancy"))


def frame_entropy(top: DataFrame, *, frame: Sequence[str] = ("frame",)) -> DataFrame:
    """Adds ``entropy`` of the shares in a frame, log2."""
    return top.withColumn("entropy", -F.sum(F.col("share") * F.log2("share")).over(Window.partitionBy(*frame)))


def conditional_entropy(top: DataFrame, *, frame: Sequence[str] = ("frame",), label: str = "label") -> DataFrame:
    """Mean entropy of frames with i and j on top, for ordered pairs i, j.

    A frame's k labels are paired in its own row; frames are not joined to
    themselves. Labels that are used less than i are no partners of it.
    """
    rows = frame_entropy(top, frame=frame)
    per = rows.groupBy(*frame).agg(F.collect_list(label).alias("_labels"), F.first("entropy").alias("entropy"))
    pairs = per.select(F.explode("_labels").alias("i"), "_labels", "entropy").select("i", F.explode("_labels").alias("j"), "entropy").where("i <> j")
    mean = pairs.groupBy("i", "j").agg(F.avg("entropy").alias("mean_entropy"), F.count(F.lit(1)).alias("n_frames"))
    occ = occupancy(top, label=label)
    met = mean.join(occ.select(F.col(label).alias("i"), F.col("occupancy").alias("occ_i")), "i").join(occ.select(F.col(label).alias("j"), F.col("occupancy").alias("occ_j")), "j")
    return met.where(F.round("occ_j", 9) >= F.round("occ_i", 9))


def neighbours(conditional: DataFrame, *, threshold: float = 0.5, k: int = 2) -> DataFrame:
    """The k partners of highest mean entropy above the threshold, per label (W20). Ties go to the larger label."""
    order = Window.partitionBy("i").orderBy(F.desc(F.round("mean_entropy", 9)), F.desc("j"))
    return conditional.where(F.col("mean_entropy") > threshold).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def merge_candidates(near: DataFrame, similarity: DataFrame) -> DataFrame:
    """Per label the first neighbour whose mean vector is similar, > 0 (S8, V3): old, new. The filter comes after the choice of k."""
    met = near.join(similarity.select("i", "j", "similarity"), ["i", "j"]).where(F.col("similarity") > 0)
    first = met.groupBy("i").agg(F.min_by("j", "rank").alias("new"), F.min_by("similarity", "rank").alias("similarity"))
    return first.select(F.col("i").alias("old"), "new", "similarity")


def merge_cycles(merge_map: DataFrame) -> DataFrame:
    """Pairs that go into each other, and chains whose target goes on: old, new, next, is_cycle. Relabelling is one pass, so both deserve a look."""
    on = merge_map.select(F.col("old").alias("new"), F.col("new").alias("next"))
    return merge_map.select("old", "new").join(on, "new").select("old", "new", "next", (F.col("next") == F.col("old")).alias("is_cycle"))


def sample_frames(frames: DataFrame, *, target: str, most: int = 3000, order: Sequence[str] = ("frame",)) -> DataFrame:
    """At most ``most`` frames for a plot, those with ``target`` first."""
    return frames.orderBy(F.desc(target), *order).limit(most)
