"""Session data in long form: listing, extraction and export of scalars, flips (IO7-IO13, X10).

Canonical tables: frames(uuid, frame_seq, h, w, px array<short>), scalars(uuid,
name, frame_seq, ts, value), pcs(uuid, frame_seq, pc). Session files are read
into them by ``read_hdf5`` and its kin, through ``session_files``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.operators.intervals import split_name
from seqlab.sources.session_files import read_sessions

PREFIX = "scalars/"


def list_datasets(scalars: DataFrame, *, scalars_only: bool = True) -> DataFrame:
    """name, number of values and type of each dataset (IO8)."""
    rows = scalars.where(F.col("name").startswith(PREFIX)) if scalars_only else scalars
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n_values")).withColumn("dtype", F.lit(dict(scalars.dtypes)["value"]))


def extract(scalars: DataFrame, name: str | None = None) -> DataFrame:
    """One dataset's rows (IO11); raises KeyError if there is none. The prefix may be left out; without a name the datasets are listed."""
    if name is None:
        return list_datasets(scalars, scalars_only=False)
    found = scalars.where(F.col("name").isin(name, f"{PREFIX}{name}"))
    if found.isEmpty():
        raise KeyError(name)
    return found


def with_timestamps(values: DataFrame, timestamps: DataFrame) -> DataFrame:
    """(timestamp, value) by place (IO10); values past the timestamps have an empty one."""
    met = values.join(timestamps.select("uuid", "frame_seq", F.col("ts").alias("_ts")), ["uuid", "frame_seq"], "left")
    return met.select("uuid", "frame_seq", F.coalesce(F.col("_ts").cast("string"), F.lit("")).alias("timestamp"), "value")


def to_json(values: DataFrame) -> DataFrame:
    """One JSON document per session with data and timestamps in frame order (IO10, X10)."""
    rows = F.array_sort(F.collect_list(F.struct("frame_seq", "timestamp", "value")))
    doc = F.struct(F.transform("r", lambda x: x["value"]).alias("data"), F.transform("r", lambda x: x["timestamp"]).alias("timestamps"))
    return values.groupBy("uuid").agg(rows.alias("r")).select("uuid", F.to_json(doc).alias("document"))


def export_dataset(values: DataFrame, path: str) -> None:
    """CSV or JSON by the path's suffix (IO9)."""
    writer = values.write.mode("overwrite")
    if path.endswith(".json"):
        writer.json(path)
    elif path.endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        raise ValueError("the path must end in .csv or .json")


def empty_mask(frames: DataFrame, *, height: int = 10) -> DataFrame:
    """(uuid, frame_seq, empty): no pixel above the height."""
    return frames.select("uuid", "frame_seq", (~F.exists("px", lambda x: x > height)).alias("empty"))


def flip_frames(frames: DataFrame) -> DataFrame:
    """Frames turned upside down (IO13): the rows of each in reverse order."""
    row = lambda i: F.slice("px", (F.col("h") - 1 - i) * F.col("w") + 1, F.col("w"))
    return frames.withColumn("px", F.flatten(F.transform(F.sequence(F.lit(0), F.col("h") - 1), row)))


def write_flipped(frames: DataFrame, path: str) -> None:
    """Flipped frames as Parquet; nothing is written where the path exists (IO13)."""
    flip_frames(frames).write.mode("ignore").parquet(path)


def split_sessions(tables: dict[str, DataFrame], ranges: DataFrame, *, key: str = "uuid", position: str = "frame_seq", keep_whole: bool = False) -> dict[str, DataFrame]:
    """Every table of the sessions cut into the ranges (uuid, start, stop, idx) (IO12).

    Rows with a position are sliced, and positions start at 0 again. What has
    none belongs to the whole session and is copied into each split: rows of
    tables without the column, and of data sets that are no frames, whose
    position is null. Either way the session becomes ``<uuid>-split-NN``.
    Sessions without ranges have no rows, or stay as they are with
    ``keep_whole`` (rows without a session too).

    Plan: one join on the session with the range as filter, and for whole ones
    one with the sessions that have ranges; ranges are few, and adaptive
    execution broadcasts them where they are small.
    """
    cut = ranges.select(F.col(key).alias("_key"), "start", "stop", "idx")
    out = {}
    for name, rows in tables.items():
        names = {c: f"_{i}" for i, c in enumerate(rows.columns)}  # a table may have columns of the ranges' names
        plain = rows.select(*(F.col(f"`{c}`").alias(v) for c, v in names.items()))
        where, at = F.col(names[key]) == F.col("_key"), F.col(names[position]) if position in names else None
        if at is not None:
            where = where & (at.isNull() | ((at >= F.col("start")) & (at < F.col("stop"))))
        met = plain.join(cut, where).withColumn(names[key], split_name("_key", "idx"))
        if at is not None:
            met = met.withColumn(names[position], at - F.col("start"))
        met = met.select(*names.values())
        if keep_whole:
            whole = plain.join(cut.select("_key").distinct(), F.col(names[key]) == F.col("_key"), "left_anti")
            met = met.unionByName(whole.withColumn(names[key], F.col(names[key]).cast("string")))
        out[name] = met.select(*(F.col(v).alias(c) for c, v in names.items()))
    return out


def split_listing(ranges: DataFrame, *, key: str = "uuid") -> DataFrame:
    """(uuid, split_id, start, stop, file) of each range: the split's name, and that of its file with the range in it (IO12, IO19)."""
    file = F.format_string("%s-start_%d_end_%d.h5", F.col(key).cast("string"), F.col("start"), F.col("stop"))
    return ranges.select(key, split_name(key, "idx").alias("split_id"), "start", "stop", file.alias("file"))


def read_hdf5(spark: SparkSession, pattern: str) -> DataFrame:
    """Scalars of session files (IO7)."""
    return read_sessions(spark, pattern, "scalars")


def read_hdf5_frames(spark: SparkSession, pattern: str) -> DataFrame:
    """Frames of session files (IO7)."""
    return read_sessions(spark, pattern, "frames")


def read_hdf5_scores(spark: SparkSession, pattern: str) -> DataFrame:
    """Scores of score files, without the first three frames and beyond ten components, as the programs take them (IO7)."""
    return read_sessions(spark, pattern, "scores")


def read_hdf5_tree(spark: SparkSession, pattern: str) -> DataFrame:
    """Name, shape and type of every dataset of session files (IO8)."""
    return read_sessions(spark, pattern, "tree")


def retire_source(path: str, sidecar: str | None = None, splits: int = 0) -> list[str]:
    """Rename a consumed file to .orig, and clone its YAML sidecar for each split with the split's uuid (IO19); the clones."""
    import copy
    import os

    from seqlab.sources.tables import read_yaml, write_yaml

    os.rename(path, f"{path}.orig")
    made = []
    for i in range(splits if sidecar else 0):
        document = copy.deepcopy(read_yaml(sidecar))
        document["uuid"] = f"{document.get('uuid', '')}-split-{i:02d}"
        base, ext = os.path.splitext(sidecar)
        made.append(f"{base}-split-{i:02d}{ext}")
        write_yaml(document, made[-1], backup=False)
    return made
