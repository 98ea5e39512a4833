"""Run-length and onset-aligned operators over ordered frames.

Frames are keyed by (session, order). Every window is partitioned by the
session columns, so that one exchange on them serves all of these operators.
``by=()`` puts all rows in one order; it exists for parity with row-position
semantics on small tables and is never the default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SESSION, ORDER = ("uuid",), ("frame_seq",)


def _window(by: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def _so_far(by: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    return _window(by, order).rowsBetween(Window.unboundedPreceding, 0)


def mark_onsets(frames: DataFrame, *, label: str = "label", by: Sequence[str] = SESSION, order: Sequence[str] = ORDER) -> DataFrame:
    """Adds ``onset``: the label differs from the frame before, or there is none."""
    before = F.lag(label).over(_window(by, order))
    first = F.row_number().over(_window(by, order)) == 1
    return frames.withColumn("onset", first | ~F.col(label).eqNullSafe(before))


def number_runs(frames: DataFrame, *, onset: str = "onset", by: Sequence[str] = SESSION, order: Sequence[str] = ORDER) -> DataFrame:
    """Adds ``run_id`` (W1): onsets so far; frames before the first onset are run 0."""
    return frames.withColumn("run_id", F.sum(F.col(onset).cast("long")).over(_so_far(by, order)))


def forward_fill(frames: DataFrame, column: str, *, by: Sequence[str] = SESSION, order: Sequence[str] = ORDER) -> DataFrame:
    """Nulls of a column take the last value before them."""
    return frames.withColumn(column, F.last(column, ignorenulls=True).over(_so_far(by, order)))


def run_durations(frames: DataFrame, *, mode: str = "forward", position: str = "frame_seq", onset: str = "onset", by: Sequence[str] = SESSION, order: Sequence[str] = ORDER) -> DataFrame:
    """Adds ``run_frames``, the duration in frames, on every frame of a run.

    ``forward`` (W2): to the next onset; the last run takes the duration before
    it. ``backward`` (W3): from the onset before (from 0 for the first), so
    that a run carries the length of the one before.
    """
    at = F.when(F.col(onset), F.col(position))
    if mode == "forward":
        coming = F.last(at, ignorenulls=True).over(_window(by, [F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1))
        frames = frames.withColumn("_until", coming)
        length = F.when(F.col(onset), F.col("_until") - F.col(position))
    elif mode == "backward":
        past = F.last(at, ignorenulls=True).over(_window(by, order).rowsBetween(Window.unboundedPreceding, -1))
        frames = frames.withColumn("_until", F.coalesce(past, F.lit(0)))
        length = F.when(F.col(onset), F.col(position) - F.col("_until"))
    else:
        raise ValueError("mode must be 'forward' or 'backward'")
    return forward_fill(frames.withColumn("run_frames", length).drop("_until"), "run_frames", by=by, order=order)


def sampling_rate(frames: DataFrame, *, ts_ms: str = "ts_ms", by: Sequence[str] = SESSION, order: Sequence[str] = ORDER) -> DataFrame:
    """One row: the median of differences within sessions (W5, A9) and fps = 1000 / median.

    The exact median of one global group keeps counts of distinct differences,
    combined before the shuffle.
    """
    steps = frames.select((F.col(ts_ms) - F.lag(ts_ms).over(_window(by, order))).alias("step")).where(F.col("step").isNotNull())
    counts = steps.groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    median = counts.agg(F.expr("percentile(step, 0.5D, n)").alias("median_ms"))
    return median.withColumn("fps", F.try_divide(F.lit(1000.0), "median_ms"))


def align_to_onset(frames: DataFrame, *, position: str = "frame_seq", value: str | None = None, run: str = "run_id", by: Sequence[str] = SESSION, order: Sequence[str] = ORDER) -> DataFrame:
    """Adds ``offset`` (W6), frames since the run's first, and, for ``value``, ``aligned`` (W7): minus the mean of the run's first two values."""
    in_run = _window([*by, run], order)
    whole = in_run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = frames.withColumn("offset", F.col(position) - F.first(position).over(in_run))
    if value is not None:
        # the mean of the first two is known from the second frame on; the first takes it from the one after
        head = F.slice(F.collect_list(F.col(value).cast("double")).over(in_run.rowsBetween(Window.currentRow, 1)), 1, 2)
        first_two = F.first(F.aggregate(head, F.lit(0.0), lambda a, x: a + x) / F.size(head)).over(whole)
        out = out.withColumn("aligned", F.col(value) - first_two)
    return out


def mean_trajectories(aligned: DataFrame, metrics: Sequence[str], *, fps: float, horizon_s: float = 0.4, label: str = "label") -> DataFrame:
    """Mean of each metric per (label, offset) up to a horizon, inclusive (A10, F7). Grouped by whole offsets; aligned_s is derived."""
    inside = aligned.where(F.col("offset") / fps <= horizon_s)
    return inside.groupBy(label, "offset").agg(*(F.avg(m).alias(m) for m in metrics), F.count(F.lit(1)).alias("n")).withColumn("aligned_s", F.col("offset") / fps)


def duration_band(frames: DataFrame, *, fps: float, low_s: float = 0.13, high_s: float = 1.0) -> DataFrame:
    """Frames of runs that last strictly between the bounds."""
    seconds = F.col("run_frames") / fps
    return frames.where((seconds > low_s) & (seconds < high_s))


def slice_session(frames: DataFrame, *, start_min: float = 0, end_min: float = 30, ts_ms: str = "ts_ms", keys: Sequence[str] = ("session_name", "subject_name", "uuid")) -> DataFrame:
    """Rows whose time since their session's first is within the bounds, both inclusive.

    Bounds are minutes, cut to whole milliseconds; rows with a null key are left out.
    """
    since = F.col(ts_ms) - F.min(ts_ms).over(Window.partitionBy(*keys))
    known = frames
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return known.withColumn("_since", since).where(F.col("_since").between(int(start_min * 60000), int(end_min * 60000))).drop("_since")
