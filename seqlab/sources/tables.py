"""Tabular sources and sinks (IO1-IO6, IO16-IO18, IO21)."""

from __future__ import annotations

import os
import shutil

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FRAME_SCHEMA = (
    "label int, label_usage_rank int, label_frames_rank int, onset boolean, frame_seq long, syllable_index long, angle double, height_ave_mm double, length_mm double, "
    "width_mm double, velocity_3d_mm double, group string, uuid string, ts_ms double, session_name string, subject_name string, start_time string"
)
STATS_SCHEMA = "group string, uuid string, syllable int, usage double"
#: Names in files of the original tools, and the names used here.
FRAME_NAMES = {
    "labels (original)": "label",
    "labels (usage sort)": "label_usage_rank",
    "labels (frames sort)": "label_frames_rank",
    "frame index": "frame_seq",
    "syllable index": "syllable_index",
    "timestamps": "ts_ms",
    "SessionName": "session_name",
    "SubjectName": "subject_name",
    "StartTime": "start_time",
    "syllable_duration (s)": "run_seconds",
    "syllable_duration": "run_frames",
    "new labels (original)": "new_label",
    "new labels (usage sort)": "new_label_usage_rank",
}


def read_csv(spark: SparkSession, path: str, *, schema: StructType | str | None = None, sep: str = ",", index: bool = False) -> DataFrame:
    """A CSV or TSV file with a header (IO1-IO3); ``index``: its first column is an index and is dropped.

    Give a schema for large files: without one they are read twice.
    """
    reader = spark.read.option("header", True).option("sep", sep)
    rows = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return rows.select(*(f"`{c}`" for c in rows.columns[1:])) if index else rows


def drop_unnamed(rows: DataFrame) -> DataFrame:
    """Without columns whose name starts with Unnamed, which index columns become (IO4)."""
    return rows.select(*(f"`{c}`" for c in rows.columns if not c.startswith("Unnamed")))


def to_internal_names(rows: DataFrame) -> DataFrame:
    """Columns of the original tools under the names used here."""
    return rows.withColumnsRenamed({k: v for k, v in FRAME_NAMES.items() if k in rows.columns})


def read_frames(spark: SparkSession, path: str, *, format: str = "parquet") -> DataFrame:
    """A frame table, under internal names."""
    return to_internal_names(drop_unnamed(read_csv(spark, path)) if format == "csv" else spark.read.parquet(path))


def write_csv(rows: DataFrame, path: str, *, sep: str = ",") -> None:
    """CSV part files with a header (IO5)."""
    rows.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_frames(frames: DataFrame, path: str, *, files: int | None = None) -> None:
    """Parquet, sorted by session and frame within files, so that readers skip row groups of other sessions."""
    dealt = frames.repartition(files, "uuid") if files else frames.repartition("uuid")
    dealt.sortWithinPartitions("uuid", "frame_seq").write.mode("overwrite").parquet(path)


def write_merge_map(merge_map: DataFrame, path: str) -> None:
    """The merge map under the original tools' column names (IO6)."""
    write_csv(merge_map.select(F.col("old").alias("labels (original) - old"), F.col("new").alias("labels (original) - new")).coalesce(1), path)


def dense_matrix(long: DataFrame, labels: list, *, i: str = "i", j: str = "j", value: str = "value") -> DataFrame:
    """A long label matrix as rows i with a column per label (IO21); missing cells are 0."""
    return long.groupBy(i).pivot(j, labels).agg(F.first(value)).na.fill(0.0).orderBy(i)


def write_matrix(dense: DataFrame, path: str, columns: list[str]) -> None:
    """Text lines of the columns' numbers in scientific form with a space between, in the order of rows (IO21)."""
    line = F.concat_ws(" ", *(F.format_string("%.18e", F.col(f"`{c}`").cast("double")) for c in columns))
    dense.select(line.alias("value")).write.mode("overwrite").text(path)


def write_report(rows: DataFrame, path: str, *, label: str, value: str, title: str | None = None) -> None:
    """A text file of the title and a line ``label: value`` with four decimals for each row, in order of label (IO21)."""
    line = F.format_string("%s: %.4f", F.col(label).cast("string"), F.col(value).cast("double"))
    lines = rows.select(F.lit(1).alias("_part"), F.col(label).alias("_label"), line.alias("value"))
    if title is not None:
        lines = lines.unionByName(rows.sparkSession.createDataFrame([(0, title)], "_part int, value string"), allowMissingColumns=True)
    lines.coalesce(1).sortWithinPartitions("_part", "_label").select("value").write.mode("overwrite").text(path)


def read_experiments(spark: SparkSession, path: str, *, features: str = "syllable_features_path") -> dict[str, DataFrame]:
    """The feature tables that a comparison file names (experiment_name and a path), by experiment.

    Raises ValueError if an experiment's name is repeated, as labels of both
    would be taken for one.
    """
    found = read_csv(spark, path).select(F.col("experiment_name").cast("string").alias("name"), F.col(features).alias("path")).collect()
    names = [r["name"] for r in found]
    if len(set(names)) != len(names):
        raise ValueError(f"experiment names must be unique: {sorted(str(n) for n in set(names) if names.count(n) > 1)}")
    return {r["name"]: drop_unnamed(read_csv(spark, r["path"])) for r in found}


def scan_folder(spark: SparkSession, pattern: str) -> DataFrame:
    """Files that a glob matches, with path and size, sorted by path (IO18)."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", "modificationTime").orderBy("path")


def read_yaml(path: str):
    with open(path) as f:
        return yaml.safe_load(f)


def write_yaml(document, path: str, *, backup: bool = True) -> None:
    """Write a document; the first time, what was there is kept as .bak (IO16, IO17)."""
    if backup and os.path.exists(path) and not os.path.exists(f"{path}.bak"):
        shutil.copyfile(path, f"{path}.bak")
    with open(path, "w") as f:
        yaml.safe_dump(document, f, sort_keys=False)
