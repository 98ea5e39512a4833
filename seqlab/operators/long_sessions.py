"""Sequence operators for sessions too long for one task.

A window partitioned by session puts a whole session in one task. Here the
window is over (session, chunk of frames) instead, and what one chunk passes on
to the next - its last label, its number of onsets, its last value - is
aggregated per chunk, scanned over the few chunks of each session, and joined
back on the same keys, so that frames are shuffled once. Results equal those of
``sequence``; ``position`` must be the frame's place in its session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames in a chunk.
CHUNK = 1 << 20


#: Frames of a session from which it is gone through in chunks.
LONG = 1 << 22


def needed(frames: DataFrame, *, key: str = "uuid", most: int = LONG) -> bool:
    """Whether a session has more than ``most`` frames: one count of each session."""
    return not frames.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).isEmpty()


def _chunked(frames: DataFrame, position: str, chunk: int) -> DataFrame:
    return frames.withColumn("_chunk", F.floor(F.col(position) / chunk))


def _carried(frames: DataFrame, key: str, summary: Column, scan) -> DataFrame:
    """``frames`` with ``_carry``: ``scan`` of the summaries of the chunks before."""
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    summaries = frames.groupBy(key, "_chunk").agg(summary.alias("_summary"))
    carry = summaries.select(F.col(key).alias("_key"), F.col("_chunk").alias("_at"), scan(F.col("_summary")).over(earlier).alias("_carry"))
    return frames.join(carry, frames[key].eqNullSafe(carry["_key"]) & (frames["_chunk"] == carry["_at"]), "left").drop("_key", "_at")


def _in_chunk(key: str, position: str):
    return Window.partitionBy(key, "_chunk").orderBy(position)


def mark_onsets(frames: DataFrame, *, label: str = "label", key: str = "uuid", position: str = "frame_seq", chunk: int = CHUNK) -> DataFrame:
    """As ``sequence.mark_onsets``: the first frame of a chunk is compared with the last of the chunk before."""
    last = F.max_by(F.struct(F.col(label).alias("label")), F.col(position))
    rows = _carried(_chunked(frames, position, chunk), key, last, F.last)
    order = _in_chunk(key, position)
    head = F.row_number().over(order) == 1
    before = F.when(head, F.col("_carry.label")).otherwise(F.lag(label).over(order))
    first = head & F.col("_carry").isNull()
    return rows.withColumn("onset", first | ~F.col(label).eqNullSafe(before)).drop("_carry", "_chunk")


def number_runs(frames: DataFrame, *, onset: str = "onset", key: str = "uuid", position: str = "frame_seq", chunk: int = CHUNK) -> DataFrame:
    """As ``sequence.number_runs``: onsets in the chunk so far, and in all chunks before."""
    n = F.col(onset).cast("long")
    rows = _carried(_chunked(frames, position, chunk), key, F.sum(n), F.sum)
    so_far = F.sum(n).over(_in_chunk(key, position).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("run_id", so_far + F.coalesce("_carry", F.lit(0))).drop("_carry", "_chunk")


def forward_fill(frames: DataFrame, column: str, *, key: str = "uuid", position: str = "frame_seq", chunk: int = CHUNK) -> DataFrame:
    """As ``sequence.forward_fill``: nulls at the head of a chunk take the last value of the chunks before."""
    last = F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(position)))
    rows = _carried(_chunked(frames, position, chunk), key, last, lambda c: F.last(c, ignorenulls=True))
    local = F.last(column, ignorenulls=True).over(_in_chunk(key, position).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(column, F.coalesce(local, F.col("_carry"))).drop("_carry", "_chunk")


def run_durations(frames: DataFrame, *, onset: str = "onset", key: str = "uuid", position: str = "frame_seq", chunk: int = CHUNK) -> DataFrame:
    """As ``sequence.run_durations`` (forward): the next onset is in the chunk, or the first of the chunks after."""
    rows = _chunked(frames, position, chunk)
    at = F.when(F.col(onset), F.col(position))
    later = Window.partitionBy(key).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy(key, "_chunk").agg(F.min(at).alias("_first"))
    coming = firsts.select(F.col(key).alias("_key"), F.col("_chunk").alias("_at"), F.last("_first", ignorenulls=True).over(later).alias("_coming"))
    rows = rows.join(coming, rows[key].eqNullSafe(coming["_key"]) & (rows["_chunk"] == coming["_at"]), "left").drop("_key", "_at")
    backwards = Window.partitionBy(key, "_chunk").orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, -1)
    until = F.coalesce(F.last(at, ignorenulls=True).over(backwards), F.col("_coming"))
    rows = rows.withColumn("_until", until).withColumn("run_frames", F.when(F.col(onset), F.col("_until") - F.col(position)))
    return forward_fill(rows.drop("_until", "_coming", "_chunk"), "run_frames", key=key, position=position, chunk=chunk)
