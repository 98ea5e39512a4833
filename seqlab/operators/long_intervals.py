"""Intervals of recordings too long for one task.

The operators of ``intervals``, chunk by chunk of frames: a chunk also gets the
frames at its neighbours' edges that reach into it (dilation), runs that touch
an edge of their chunk are joined over the chunks of the recording, of which
there are few, and what an interval needs of those before is carried from chunk
to chunk. Results equal those of ``intervals`` for any size of chunk;
``position`` must be the frame's place in its recording, from 0.

Runs and intervals are few beside frames and are used more than once, so each
step writes them first: frames are gone through once, not once per use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlab.operators.long_sessions import CHUNK, _carried, _chunked, _in_chunk
from seqlab.sources.scratch import saved


def dilate(frames: DataFrame, *, mask: str = "empty", width: int = 9, key: str = "uuid", position: str = "frame_seq", chunk: int = CHUNK) -> DataFrame:
    """As ``intervals.dilate``: only frames within the window's reach of an edge are copied, to the chunks that they reach into."""
    before, after = width // 2, (width - 1) // 2
    at = F.col(position)
    own = _chunked(frames, position, chunk).withColumn("_own", F.lit(True))
    reach = F.explode(F.sequence(F.floor((at - after) / chunk), F.floor((at + before) / chunk)))
    halo = frames.where(F.col(mask).isNotNull()).select(key, position, mask, reach.alias("_chunk"), F.lit(False).alias("_own")).where(F.col("_chunk") != F.floor(at / chunk))
    near = Window.partitionBy(key, "_chunk").orderBy(position).rangeBetween(-before, after)
    met = own.unionByName(halo, allowMissingColumns=True).withColumn("dilated", F.max(F.col(mask).cast("int")).over(near) == 1)
    return met.where("_own").select(*frames.columns, "dilated")


def empty_intervals(frames: DataFrame, *, mask: str = "dilated", key: str = "uuid", position: str = "frame_seq", longer_than: int = 150, chunk: int = CHUNK) -> DataFrame:
    """As ``intervals.empty_intervals``: at most two runs of a chunk are open at its edges; these alone are joined over the recording."""
    rows = _chunked(frames.select(key, position, mask), position, chunk)
    order = _in_chunk(key, position)
    edge = (F.col(mask) & ~F.coalesce(F.lag(mask).over(order), F.lit(False))).cast("long")
    runs = rows.withColumn("_edge", edge).withColumn("_run", F.sum("_edge").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col(mask))
    runs = runs.groupBy(key, "_chunk", "_run").agg(F.min(position).alias("_first"), F.max(position).alias("_last")).drop("_run")
    runs = saved(runs, "runs")
    open_ = (F.col("_first") == F.col("_chunk") * chunk) | (F.col("_last") == (F.col("_chunk") + 1) * chunk - 1)
    along = Window.partitionBy(key).orderBy("_first")
    islands = runs.where(open_).withColumn("_new", (~F.col("_first").eqNullSafe(F.lag("_last").over(along) + 1)).cast("long"))
    islands = islands.withColumn("_island", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = islands.groupBy(key, "_island").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    whole = runs.where(~open_).select(key, "_first", "_last").unionByName(joined.select(key, "_first", "_last"))
    n = frames.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("n_frames"))
    found = whole.join(n, whole[key].eqNullSafe(n["_key"])).withColumn("s", F.col("_first") - 1)
    found = found.withColumn("e", F.when(F.col("_last") == F.col("n_frames") - 1, F.col("n_frames")).otherwise(F.col("_last")))
    return found.where(F.col("e") - F.col("s") > longer_than).select(key, "s", "e", "n_frames")


def merge_intervals(intervals: DataFrame, *, gap: int = 300, key: str = "uuid", chunk: int = CHUNK) -> DataFrame:
    """As ``intervals.merge_intervals``: the end of the last interval, and the number of islands, are carried from chunk to chunk."""
    order = _in_chunk(key, "s")
    intervals = saved(intervals, "intervals")
    rows = _carried(_chunked(intervals, "s", chunk), key, F.max_by("e", "s"), lambda c: F.last(c, ignorenulls=True))
    before = F.coalesce(F.lag("e").over(order), F.col("_carry"))
    rows = rows.withColumn("_new", (before.isNull() | (F.col("s") - before >= gap)).cast("long")).drop("_carry")
    rows = _carried(rows, key, F.sum("_new"), F.sum)
    islands = rows.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("_carry", F.lit(0)))
    return islands.groupBy(key, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.first("n_frames").alias("n_frames")).select(key, "s", "e", "n_frames")


def kept_ranges(intervals: DataFrame, *, key: str = "uuid", chunk: int = CHUNK) -> DataFrame:
    """As ``intervals.kept_ranges``: starts and places are carried from chunk to chunk."""
    intervals = saved(intervals, "intervals")
    rows = _carried(_chunked(intervals, "s", chunk), key, F.max_by("e", "s"), lambda c: F.last(c, ignorenulls=True))
    start = F.coalesce(F.lag("e").over(_in_chunk(key, "s")), F.col("_carry"), F.lit(0)).cast("long")
    heads = rows.select(key, start.alias("start"), F.col("s").cast("long").alias("stop"))
    tails = intervals.groupBy(key).agg(F.max("e").cast("long").alias("start"), F.first("n_frames").cast("long").alias("stop"))
    ranges = _chunked(heads.unionByName(tails).where(F.col("start") < F.col("stop")), "start", chunk)
    ranges = _carried(ranges, key, F.count(F.lit(1)), F.sum)
    place = F.row_number().over(_in_chunk(key, "start")) - 1 + F.coalesce("_carry", F.lit(0))
    return ranges.withColumn("idx", place.cast("int")).select(key, "start", "stop", "idx")
