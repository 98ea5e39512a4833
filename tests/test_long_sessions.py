"""Chunked sequence operators equal the plain ones."""

import random

import pytest

from seqlab.operators import intervals, long_intervals, long_sessions, sequence
from seqlab.plans import programs


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(7)
    rows = [(u, i, rng.choice("aab") if rng.random() < 0.9 else None, rng.choice([None, None, float(i)])) for u, n in (("s", 57), ("t", 9), ("u", 1), (None, 12)) for i in range(n)]
    return spark.createDataFrame(rows, "uuid string, frame_seq long, label string, value double").repartition(5).cache()


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select("uuid", "frame_seq", *columns).collect()), key=str)


@pytest.mark.parametrize("chunk", [4, 10, 1000])
def test_chunks_do_not_show(frames, chunk):
    plain, long = sequence.mark_onsets(frames), long_sessions.mark_onsets(frames, chunk=chunk)
    assert rows(plain, "label", "onset") == rows(long, "label", "onset")
    assert rows(sequence.number_runs(plain), "run_id") == rows(long_sessions.number_runs(plain, chunk=chunk), "run_id")
    assert rows(sequence.forward_fill(frames, "value"), "value") == rows(long_sessions.forward_fill(frames, "value", chunk=chunk), "value")
    assert rows(sequence.run_durations(plain), "run_frames") == rows(long_sessions.run_durations(plain, chunk=chunk), "run_frames")


@pytest.fixture(scope="module")
def recordings(spark):
    rng = random.Random(9)
    rows = []
    for u, n, p in (("s", 90, 0.9), ("t", 40, 0.5), ("full", 25, 0.0), ("none", 7, 1.1), ("u", 1, 0.0), (None, 33, 0.6)):
        on = False
        for i in range(n):
            on = rng.random() > p or (on and rng.random() < 0.8)
            rows.append((u, i, None if rng.random() < 0.05 and p < 1 and p > 0 else on, "a"))
    return spark.createDataFrame(rows, "uuid string, frame_seq long, empty boolean, s string").repartition(4).cache()


def sets(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 40, 200])
@pytest.mark.parametrize("width", [1, 4, 9])
def test_interval_chunks_do_not_show(recordings, chunk, width):
    plain, long = intervals.dilate(recordings, width=width), long_intervals.dilate(recordings, width=width, chunk=chunk)
    assert plain.columns == long.columns and rows(plain, "empty", "s", "dilated") == rows(long, "empty", "s", "dilated")
    marked = plain.select("uuid", "frame_seq", "dilated").cache()
    a = intervals.empty_intervals(marked, longer_than=2)
    assert sets(a) == sets(long_intervals.empty_intervals(marked, longer_than=2, chunk=chunk)) != []
    m = intervals.merge_intervals(a, gap=5)
    assert sets(m) == sets(long_intervals.merge_intervals(a, gap=5, chunk=chunk))
    assert sets(intervals.kept_ranges(m)) == sets(long_intervals.kept_ranges(m, chunk=chunk)) != []


def test_programs_choose_chunks(recordings, monkeypatch):
    frames = recordings.where("uuid IS NOT NULL").fillna(False, ["empty"])
    whole = programs.empty_ranges(frames, split_threshold=3, filter_size=3)[1]
    real, calls = long_intervals.dilate, []
    monkeypatch.setattr(long_intervals, "dilate", lambda *a, **k: calls.append(1) or real(*a, **k, chunk=8))
    assert sets(programs.empty_ranges(frames, split_threshold=3, filter_size=3, long_from=50)[1]) == sets(whole) != []
    assert calls == [1]
    programs.empty_ranges(frames, split_threshold=3, filter_size=3, long_from=90)
    assert calls == [1]  # the longest has 90 frames
