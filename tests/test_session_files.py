"""Session files as a source and session documents as a sink, on real files."""

import csv
import json
import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlab.sources import session_files, session_store


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two sessions and a file of scores, one of them compressed."""
    at = tmp_path_factory.mktemp("files")
    for n, (name, save) in enumerate((("a", np.savez), ("b", np.savez_compressed))):
        frames = np.arange((50 + n) * 6, dtype=np.uint8).reshape(-1, 2, 3)
        own = {"uuid": np.array(f"s-{name}")} if n == 0 else {}
        save(f"{at}/{name}.npz", frames=frames, timestamps=np.arange(40.0), **own, **{"scalars/h": np.arange(50 + n), "scalars/w": np.arange(30) / 4})
    np.savez(f"{at}/scores.zip.npz", **{"scores/u": np.arange(60 * 12.0).reshape(60, 12), "scores/short": np.zeros((2, 12)), "other": np.zeros(3)})
    return at


@pytest.mark.parametrize("options", [{}, {"rows": 7, "split_bytes": 0}])
def test_tables_of_files(spark, folder, options):
    found = session_files.read_sessions(spark, f"{folder}/[ab].npz", **options)
    rows = {(r["uuid"], r["name"], r["frame_seq"]): (r["ts"], r["value"]) for r in found.collect()}
    b = f"{folder}/b.npz"
    assert len(rows) == found.count() == 50 + 51 + 30 + 30
    assert rows["s-a", "scalars/h", 39] == (39.0, 39.0) and rows["s-a", "scalars/h", 40] == (None, 40.0) and rows[b, "scalars/w", 7] == (7.0, 1.75)
    frames = session_files.read_sessions(spark, f"{folder}/a.npz,{b}", "frames", **options)
    px = {(r["uuid"], r["frame_seq"]): (r["h"], r["w"], r["px"]) for r in frames.collect()}
    assert len(px) == 101 and px["s-a", 49] == (2, 3, [x % 256 for x in range(294, 300)]) and px[b, 0][2] == [0, 1, 2, 3, 4, 5]
    scores = session_files.read_sessions(spark, f"{folder}/scores*.npz", "scores", **options).orderBy("frame_seq").collect()
    assert [r["frame_seq"] for r in scores] == list(range(3, 60)) and scores[0]["pc"] == [36.0 + i for i in range(10)] and {r["uuid"] for r in scores} == {"u"}
    tree = {r["name"]: (r["shape"], r["dtype"]) for r in session_store.read_hdf5_tree(spark, f"{folder}/a.npz").collect()}
    assert tree == {"uuid": ([], "<U3"), "frames": ([50, 2, 3], "uint8"), "timestamps": ([40], "float64"), "scalars/h": ([50], "int64"), "scalars/w": ([30], "float64")}
    with pytest.raises(Exception, match="none"):
        session_files.read_sessions(spark, f"{folder}/none*", **options).count()
    with pytest.raises(ValueError):
        session_files.read_sessions(spark, f"{folder}/a.npz", "pictures")


def test_partitions_and_filters(spark, folder):
    every = session_files.SessionReader("frames", [f"{folder}/a.npz", f"{folder}/b.npz"], 20, 0)
    assert [(p.start, p.stop) for p in every.partitions()] == [(0, 20), (20, 40), (40, 50), (0, 20), (20, 40), (40, 51)]
    wanted = session_files.Wanted(names=["scalars/h"], low=10, high=35)
    some = session_files.SessionReader("scalars", [f"{folder}/a.npz"], 20, 0, wanted)
    assert [(p.name, p.start, p.stop) for p in some.partitions()] == [("scalars/h", 10, 30), ("scalars/h", 30, 35)]
    for options in ({}, {"rows": 7, "split_bytes": 0}):
        read = lambda **more: session_files.read_sessions(spark, f"{folder}/[ab].npz", **options, **more)  # noqa: B023, E731
        assert read(sessions=["s-a"]).count() == 80 and read(sessions=["x"]).count() == read(names=[]).count() == 0
        some = read(sessions=["s-a", "x"], names=["scalars/h"], first=10, stop=21)
        assert sorted(r["value"] for r in some.collect()) == [float(i) for i in range(10, 21)]
        assert read(names=["scalars/w"], first=25).count() == 10
        df = read()  # filters are Spark's own, in any order
        assert [df.where(c).count() for c in ("uuid = 's-a'", "frame_seq = 3 AND value < 1", "uuid = 's-a' OR frame_seq = 0", "true")] == [80, 2, 82, 161]


def test_hdf5_behind_the_same_protocol(folder, monkeypatch):
    """A stand-in for h5py over the same arrays: what the HDF5 container asks of it."""

    class File:
        def __init__(self, path, mode):
            self.arrays = dict(np.load(path.replace(".h5", ".npz")))

        def visititems(self, visit):
            visit("scalars", object())
            for name, x in self.arrays.items():
                visit(name, x)

        def __getitem__(self, name):
            return self.arrays[name]

        def close(self):
            pass

    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=File))
    monkeypatch.setattr(session_files.os.path, "getsize", lambda path: 1)
    def read(table, path):
        reader = session_files.SessionReader(table, [path], 9, 0)
        return [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]

    for table in session_files.TABLES:
        mine, theirs = read(table, f"{folder}/a.h5"), read(table, f"{folder}/a.npz")
        assert [r | {"path": ""} for r in mine] == [r | {"path": ""} for r in theirs]
        assert mine or table == "scores"


def test_documents_by_session(spark, tmp_path):
    rows = [("a/1", i, f"t{i}", float(i)) for i in range(5)] + [("b", 1, None, None), ("b", 0, 'x,"y', 0.5), (None, 0, "", 2.0)]
    df = spark.createDataFrame(rows, "uuid string, frame_seq long, timestamp string, value double").repartition(4)
    session_files.export_sessions(df, f"{tmp_path}/csv")
    assert sorted(p.name for p in (tmp_path / "csv").iterdir()) == ["a%2F1.csv", "b.csv", "null.csv"]
    with open(tmp_path / "csv/b.csv", newline="") as f:
        assert list(csv.reader(f)) == [["frame_seq", "timestamp", "value"], ["0", 'x,"y', "0.5"], ["1", "", ""]]
    session_files.export_sessions(df, f"{tmp_path}/json", kind="json")
    assert json.loads((tmp_path / "json/a%2F1.json").read_text()) == {"data": [0.0, 1.0, 2.0, 3.0, 4.0], "timestamps": ["t0", "t1", "t2", "t3", "t4"]}
    with pytest.raises(Exception, match="FileExists"):
        session_files.export_sessions(df, f"{tmp_path}/json", kind="json")
    session_files.export_sessions(df.where("uuid = 'b'"), f"{tmp_path}/json", kind="json", overwrite=True)
    assert [p.name for p in (tmp_path / "json").iterdir()] == ["b.json"]


def test_a_session_of_five_million_frames(spark, tmp_path):
    n = 5_000_000
    df = spark.range(n).select(F.lit("long").alias("uuid"), F.col("id").alias("frame_seq"), F.lit("t").alias("timestamp"), (F.col("id") % 1000).cast("double").alias("value"))
    session_files.export_sessions(df, f"{tmp_path}/out")
    back = spark.read.option("header", True).schema("frame_seq long, timestamp string, value double").csv(f"{tmp_path}/out/long.csv")
    got = back.agg(F.count("*"), F.sum("value"), F.min("frame_seq"), F.max("frame_seq"), F.countDistinct("timestamp")).first()
    assert tuple(got) == (n, 499.5 * n, 0, n - 1, 1)
    with open(tmp_path / "out/long.csv") as f:
        assert [next(f) for _ in range(3)] == ["frame_seq,timestamp,value\n", "0,t,0.0\n", "1,t,1.0\n"]


def test_a_failed_task_leaves_no_document(spark, tmp_path):
    rows = spark.range(2000).select(F.concat(F.lit("s"), F.col("id") % 8).alias("uuid"), F.col("id").alias("frame_seq"), F.lit("t").alias("timestamp"), F.col("id").cast("double").alias("value"))
    session_files.export_sessions(rows.where("uuid = 's0'"), f"{tmp_path}/out")
    bad = rows.withColumn("value", F.when(F.col("frame_seq") == 1999, F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        session_files.export_sessions(bad, f"{tmp_path}/out")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["s0.csv"]
