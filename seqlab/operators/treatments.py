"""Treatments and index documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.functions.text import stem, without_literal

KEYS = ("matcher", "day", "session", "box")

#: Where a row stood in the file map and in the schedule.
PLACES = ("file_position", "dosing_position")


def with_positions(file_map: DataFrame, dosing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables, as they are read from a file each, with their rows' places (PLACES), which only grow along a file."""
    return tuple(t.withColumn(c, F.monotonically_increasing_id()) for t, c in zip((file_map, dosing), PLACES, strict=True))


def merge_schedules(file_map: DataFrame, dosing: DataFrame, *, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Full outer join on the keys, nulls equal (J1); the file name loses .mp4."""
    right = dosing.select(*(F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in dosing.columns))
    same = reduce(lambda a, b: a & b, (file_map[k].eqNullSafe(right[f"_{k}"]) for k in keys))
    met = file_map.join(right, same, "full_outer")
    out = met.select(*(F.coalesce(k, f"_{k}").alias(k) for k in keys), *(c for c in met.columns if c not in keys and c.lstrip("_") not in keys))
    return out.withColumn("filename_clean", without_literal(F.col("filename")))


def update_groups(files: DataFrame, merged: DataFrame, *, order: Sequence[str] = KEYS + PLACES) -> DataFrame:
    """Files (path, group) with the treatment of their stem as group (J3); without one the group stays.

    Of rows that repeat a file name the last counts: a merged table is in
    ascending order of its keys, and of places in the files among equal ones
    (``with_positions``). ``order`` names these; those that ``merged`` has count
    (nulls come first). Rows equal in them are told apart by the treatment. A
    null treatment of the last row leaves the group as it is. ``changed`` marks
    files whose group is another now (J12).
    """
    place = F.struct(*(F.col(c) for c in order if c in merged.columns), "treat")
    treat = merged.where(F.col("filename_clean").isNotNull()).groupBy(F.col("filename_clean").alias("_stem")).agg(F.max_by("treat", place).alias("_treat"))
    met = files.withColumn("_name", stem(F.col("path"))).join(treat, F.col("_name") == F.col("_stem"), "left")
    new = F.coalesce("_treat", "group")
    return met.withColumn("changed", ~new.eqNullSafe(F.col("group"))).withColumn("group", new).drop("_name", "_stem", "_treat")


def _name(path: Column) -> Column:
    """The last component as ``pathlib`` gives it: empty components and '.' don't count, a path without others has the empty name."""
    return F.coalesce(F.try_element_at(F.filter(F.split(path, "/"), lambda x: (x != "") & (x != ".")), F.lit(-1)), F.when(path.isNotNull(), F.lit("")))


def groups_by_suffix(target: DataFrame, source: DataFrame) -> DataFrame:
    """Target files (path) with the group of the first source file, by position, whose path ends in their name.

    A name may end a longer component ('x.h5' is in '/a/box.h5'), and a path
    without a name has the empty one, which ends every path. One row per
    distinct target path; ``found`` tells files without a source. A null path
    matches nothing.

    Plan: distinct names have few lengths, which are broadcast; a source path
    gives a suffix for each, and the first source of a suffix is combined
    before the shuffle, so no join has many rows on both sides.
    """
    t = target.dropDuplicates(["path"]).withColumn("_name", _name(F.col("path")))
    lengths = t.where("_name is not null").select(F.length("_name").alias("_n")).distinct()
    s = source.where("path is not null").select("position", "path", F.col("group").alias("source_group")).join(F.broadcast(lengths), F.length("path") >= F.col("_n"))
    first = s.groupBy(F.right("path", F.col("_n")).alias("_suffix")).agg(F.min(F.struct("position", "path", "source_group")).alias("_first"))
    met = t.join(first, F.col("_name") == F.col("_suffix"), "left")
    return met.withColumn("source_group", F.col("_first.source_group")).withColumn("found", F.col("_first").isNotNull()).drop("_name", "_suffix", "_first")


def groups_by_name(target: DataFrame, source: DataFrame) -> DataFrame:
    """Target files (path) with the group of the first source file whose text after the last '/' equals theirs.

    Narrower than F16: a name that ends a longer component is no match, and
    paths that end in '/' match each other only. See ``groups_by_suffix``.
    """
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    t = target.dropDuplicates(["path"]).withColumn("_name", last("path"))
    first = source.groupBy(last("path").alias("_key")).agg(F.min(F.struct("position", "path", F.col("group").alias("source_group"))).alias("_first"))
    met = t.join(first, F.col("_name") == F.col("_key"), "left")
    return met.withColumn("source_group", F.col("_first.source_group")).withColumn("found", F.col("_first").isNotNull()).drop("_name", "_key", "_first")


def index_to_rows(spark: SparkSession, document: dict) -> DataFrame:
    """The files of an index document as (position, path, group)."""
    rows = [(i, x["path"][0], x.get("group")) for i, x in enumerate(document["files"])]
    return spark.createDataFrame(rows, "position int, path string, `group` string")


def rows_to_index(document: dict, rows: DataFrame) -> dict:
    """A copy of the document with the groups of the rows; an index has a file per session."""
    groups = {r["path"]: r["group"] for r in rows.select("path", "group").collect()}
    return document | {"files": [x | {"group": groups.get(x["path"][0], x.get("group"))} for x in document["files"]]}
