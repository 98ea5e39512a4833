"""Empty intervals of recordings: detection, merging, inversion, splitting (F13, A21, W9, W11-W14, J10, IO12, X5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def empty_fraction(frames: DataFrame, *, empty: str = "empty", key: str = "uuid", threshold: float = 10.0) -> DataFrame:
    """Empty frames per recording: n_empty, percent, and flagged if percent >= threshold."""
    n = F.sum(F.col(empty).cast("long"))
    out = frames.groupBy(key).agg(n.alias("n_empty"), F.count(F.lit(1)).alias("n_frames"))
    return out.withColumn("percent", 100.0 * F.col("n_empty") / F.col("n_frames")).withColumn("flagged", F.col("percent") >= threshold)


def dilate(frames: DataFrame, *, mask: str = "empty", width: int = 9, key: str = "uuid", order: Sequence[str] = ("frame_seq",)) -> DataFrame:
    """Adds ``dilated``: any empty frame within a window of ``width`` frames (W9); at the ends the window is cut."""
    before, after = width // 2, (width - 1) // 2
    near = Window.partitionBy(key).orderBy(*order).rowsBetween(-before, after)
    return frames.withColumn("dilated", F.max(F.col(mask).cast("int")).over(near) == 1)


def empty_intervals(frames: DataFrame, *, mask: str = "dilated", key: str = "uuid", position: str = "frame_seq", longer_than: int = 150) -> DataFrame:
    """Intervals (s, e) of the mask (W11, W12): s is the last position before it (-1 at the start), e its last position (the number of frames if it lasts to the end); only e - s > longer_than."""
    order = Window.partitionBy(key).orderBy(position)
    edge = (F.col(mask) & ~F.coalesce(F.lag(mask).over(order), F.lit(False))).cast("long")
    marked = frames.select(key, position, mask, edge.alias("_edge"), F.count(F.lit(1)).over(Window.partitionBy(key)).alias("n_frames"))
    runs = marked.withColumn("_run", F.sum("_edge").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col(mask))
    last = F.max(position)
    found = runs.groupBy(key, "_run").agg((F.min(position) - 1).alias("s"), last.alias("_last"), F.first("n_frames").alias("n_frames"))
    found = found.withColumn("e", F.when(F.col("_last") == F.col("n_frames") - 1, F.col("n_frames")).otherwise(F.col("_last")))
    return found.where(F.col("e") - F.col("s") > longer_than).select(key, "s", "e", "n_frames")


def merge_intervals(intervals: DataFrame, *, gap: int = 300, key: str = "uuid") -> DataFrame:
    """Intervals joined to the one before if s - its end < gap."""
    order = Window.partitionBy(key).orderBy("s")
    before = F.lag("e").over(order)
    new = (before.isNull() | (F.col("s") - before >= gap)).cast("int")
    islands = intervals.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.first("n_frames").alias("n_frames")).select(key, "s", "e", "n_frames")


def kept_ranges(intervals: DataFrame, *, key: str = "uuid") -> DataFrame:
    """Half-open ranges (start, stop) outside the intervals, with their place from 0 (W14); recordings without intervals have no rows."""
    order = Window.partitionBy(key).orderBy("s")
    heads = intervals.select(key, F.coalesce(F.lag("e").over(order), F.lit(0)).cast("long").alias("start"), F.col("s").cast("long").alias("stop"))
    tails = intervals.groupBy(key).agg(F.max("e").cast("long").alias("start"), F.first("n_frames").cast("long").alias("stop"))
    ranges = heads.unionByName(tails).where(F.col("start") < F.col("stop"))
    return ranges.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy("start")) - 1)


def split_name(key: str, idx: str) -> Column:
    """A recording's name with -split-NN."""
    return F.concat(F.col(key).cast("string"), F.format_string("-split-%02d", F.col(idx).cast("int")))


def split_by_ranges(frames: DataFrame, ranges: DataFrame, *, key: str = "uuid", position: str = "frame_seq") -> DataFrame:
    """Frames of each range (J10, IO12): split_id is the recording's name with -split-NN, position starts at 0 again.

    The range join is an equi-join on the recording with the range as filter, so
    nothing is compared across recordings.
    """
    r = ranges.select(F.col(key).alias("_key"), "start", "stop", "idx")
    met = frames.join(r, (frames[key] == r["_key"]) & (frames[position] >= r["start"]) & (frames[position] < r["stop"]))
    return met.withColumn("split_id", split_name(key, "idx")).withColumn("split_seq", F.col(position) - F.col("start")).drop("_key", "start", "stop", "idx")
