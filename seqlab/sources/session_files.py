"""Session files as a data source, and one document per session as a sink (IO7-IO10, IO12).

A session file holds named arrays: ``uuid``, ``timestamps``, ``frames``,
``scalars/<name>``, ``scores/<uuid>``. Two containers are read behind one
protocol: zip files of raw arrays (.npz), and HDF5 where h5py is installed.

Reading is planned by file, dataset and range of rows, so that a large file is
read by many tasks, and what is told of sessions, datasets and frames decides
what is planned at all. (These are options, not filters that Spark pushes down:
Spark 4.1.2 keeps a source's pushed filters for later queries of the same
DataFrame that push none, which then lack rows.) Files must be on a path that
driver and workers can open.

Writing streams sorted rows: a task writes each of its sessions to a document
of its own, and the documents take their names only when the job commits.
"""

from __future__ import annotations

import glob
import json
import os
import shutil
import uuid as uuids
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCALARS, SCORES = "scalars/", "scores/"

#: By table: its schema, and the rows of a partition.
TABLES = {
    "scalars": ("uuid string, name string, frame_seq long, ts double, value double", 1 << 18),
    "frames": ("uuid string, frame_seq long, h int, w int, px array<short>", 1 << 11),
    "scores": ("uuid string, frame_seq long, pc array<double>", 1 << 16),
    "tree": ("path string, name string, shape array<long>, dtype string", 1 << 16),
}

#: Frames at the start of a session that scores leave out, and components that are taken.
UNSCORED, COMPONENTS = 3, 10


class ZipArrays:
    """The arrays of a zip file of .npy members; rows of a stored member are read by their place in the file."""

    def __init__(self, path: str):
        self.zip = zipfile.ZipFile(path)
        self.members = {m.filename.removesuffix(".npy"): m for m in self.zip.infolist() if m.filename.endswith(".npy")}
        self.heads: dict[str, tuple] = {}

    def names(self) -> list[str]:
        return list(self.members)

    def _head(self, name: str) -> tuple[tuple[int, ...], bool, np.dtype, int]:
        if name not in self.heads:
            with self.zip.open(self.members[name]) as f:
                version = np.lib.format.read_magic(f)
                read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                self.heads[name] = (*read(f), f.tell())
        return self.heads[name]

    def shape(self, name: str) -> tuple[int, ...]:
        return self._head(name)[0]

    def dtype(self, name: str) -> str:
        return str(self._head(name)[2])

    def rows(self, name: str, start: int, stop: int) -> np.ndarray:
        """Rows start to stop (all of an array without dimensions)."""
        shape, fortran, dtype, at = self._head(name)
        if fortran and len(shape) > 1:
            raise ValueError(f"{name}: arrays in column order have no rows to read")
        width = int(np.prod(shape[1:], dtype=np.int64)) * dtype.itemsize
        n = (max(0, min(stop, shape[0]) - start) * width) if shape else dtype.itemsize
        with self.zip.open(self.members[name]) as f:
            f.seek(at + (start * width if shape else 0))  # a stored member is skipped, a compressed one is read up to there
            data = f.read(n)
        return np.frombuffer(data, dtype).reshape(-1, *shape[1:]) if shape else np.frombuffer(data, dtype).reshape(())

    def close(self) -> None:
        self.zip.close()


class Hdf5Arrays:
    """The datasets of an HDF5 file."""

    def __init__(self, path: str):
        import h5py

        self.file = h5py.File(path, "r")

    def names(self) -> list[str]:
        found: list[str] = []
        self.file.visititems(lambda name, x: found.append(name) if hasattr(x, "shape") else None)
        return found

    def shape(self, name: str) -> tuple[int, ...]:
        return self.file[name].shape

    def dtype(self, name: str) -> str:
        return str(self.file[name].dtype)

    def rows(self, name: str, start: int, stop: int) -> np.ndarray:
        return np.asarray(self.file[name][start:stop] if self.file[name].shape else self.file[name][()])

    def close(self) -> None:
        self.file.close()


def open_arrays(path: str):
    return ZipArrays(path) if path.endswith((".npz", ".zip")) else Hdf5Arrays(path)


def _session(arrays, path: str) -> str:
    """The session's name: the file's own, else its path."""
    if "uuid" not in arrays.names():
        return path
    raw = arrays.rows("uuid", 0, 1).item()
    return raw.decode() if isinstance(raw, bytes) else str(raw)


@dataclass
class Part(InputPartition):
    """Rows of a dataset of a file; all datasets of the table, and all rows, if they are not told."""

    path: str
    name: str | None = None
    start: int = 0
    stop: int | None = None


@dataclass
class Wanted:
    """Sessions, datasets and the range of frames that are to be read; None is all."""

    sessions: Sequence[str] | None = None
    names: Sequence[str] | None = None
    low: int = 0
    high: int | None = None

    def holds(self, session: str, name: str) -> bool:
        return (self.sessions is None or session in self.sessions) and (self.names is None or name in self.names)

    def bounds(self, start: int, stop: int) -> tuple[int, int]:
        return max(start, self.low), stop if self.high is None else min(stop, self.high)


class SessionReader(DataSourceReader):
    def __init__(self, table: str, paths: Sequence[str], rows: int, split_bytes: int, wanted: Wanted | None = None):
        self.table, self.paths, self.rows, self.split_bytes = table, paths, rows, split_bytes
        self.wanted = wanted or Wanted()

    def _datasets(self, arrays, path: str) -> Iterator[tuple[str, str, int, int]]:
        """(session, dataset, first row, number of rows) of the table's datasets that are wanted."""
        first = 0
        if self.table == "scores":
            found, first = [(n.removeprefix(SCORES), n) for n in arrays.names() if n.startswith(SCORES)], UNSCORED
        else:
            own = _session(arrays, path)
            found = [(own, n) for n in arrays.names() if (n == "frames" if self.table == "frames" else n.startswith(SCALARS))]
        for session, name in found:
            if self.wanted.holds(session, name):
                yield session, name, first, arrays.shape(name)[0]

    def partitions(self) -> list[Part]:
        """A small file is one partition; of a large one each dataset is cut into ranges of rows."""
        out = []
        for path in self.paths:
            if self.table == "tree" or os.path.getsize(path) <= self.split_bytes:
                out.append(Part(path))
                continue
            arrays = open_arrays(path)
            try:
                for _, name, first, n in self._datasets(arrays, path):
                    low, high = self.wanted.bounds(first, n)
                    out += [Part(path, name, a, min(a + self.rows, high)) for a in range(low, high, self.rows)]
            finally:
                arrays.close()
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        arrays = open_arrays(partition.path)
        try:
            if self.table == "tree":
                names = arrays.names()
                columns = [pa.array([partition.path] * len(names), pa.string()), pa.array(names, pa.string()), pa.array([list(arrays.shape(n)) for n in names], pa.list_(pa.int64())), pa.array([arrays.dtype(n) for n in names], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "name", "shape", "dtype"])
                return
            for session, name, first, n in self._datasets(arrays, partition.path):
                if partition.name in (None, name):
                    low, high = self.wanted.bounds(max(first, partition.start), n if partition.stop is None else partition.stop)
                    for a in range(low, high, min(self.rows, 1 << 14)):
                        yield self._batch(arrays, session, name, a, min(a + min(self.rows, 1 << 14), high))
        finally:
            arrays.close()

    def _batch(self, arrays, session: str, name: str, start: int, stop: int) -> pa.RecordBatch:
        rows = arrays.rows(name, start, stop)
        n = len(rows)
        columns = {"uuid": pa.array([session] * n, pa.string()), "frame_seq": pa.array(range(start, start + n), pa.int64())}
        if self.table == "scalars":
            known = "timestamps" in arrays.names()
            ts = arrays.rows("timestamps", start, stop).astype(float).tolist() if known else []
            columns = {"uuid": columns["uuid"], "name": pa.array([name] * n, pa.string()), "frame_seq": columns["frame_seq"], "ts": pa.array(ts + [None] * (n - len(ts)), pa.float64()), "value": pa.array(rows.astype(float))}
        elif self.table == "frames":
            h, w = rows.shape[1:]
            flat = pa.array(np.ascontiguousarray(rows.reshape(-1)).astype(np.int16))
            columns |= {"h": pa.array([h] * n, pa.int32()), "w": pa.array([w] * n, pa.int32()), "px": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (h * w)), flat)}
        else:
            part = np.ascontiguousarray(rows[:, :COMPONENTS].astype(float))
            columns["pc"] = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * part.shape[1]), pa.array(part.reshape(-1)))
        return pa.RecordBatch.from_pydict(columns)


class SessionFiles(DataSource):
    """Options: path (glob patterns, separated by commas), table (of TABLES), rows (of a partition), split_bytes (of a file that is one partition at most), wanted (JSON of Wanted's fields)."""

    @classmethod
    def name(cls) -> str:
        return "session_files"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "scalars")][0]

    def reader(self, schema) -> SessionReader:
        table = self.options.get("table", "scalars")
        paths = sorted({p for pattern in self.options["path"].split(",") for p in glob.glob(pattern)})
        if not paths:
            raise FileNotFoundError(self.options["path"])
        return SessionReader(table, paths, int(self.options.get("rows", TABLES[table][1])), int(self.options.get("split_bytes", 1 << 24)), Wanted(**json.loads(self.options.get("wanted", "{}"))))


def register(spark: SparkSession) -> None:
    """Make the source and the sink known to a session."""
    spark.dataSource.register(SessionFiles)
    spark.dataSource.register(SessionDocuments)


def read_sessions(spark: SparkSession, pattern: str, table: str = "scalars", *, sessions: Sequence[str] | None = None, names: Sequence[str] | None = None, first: int = 0, stop: int | None = None, **options) -> DataFrame:
    """A table of session files: scalars, frames, scores (without the first three frames and beyond ten components), or the tree of datasets.

    Only the given ``sessions``, datasets (``names``) and frames from ``first`` to
    before ``stop`` are read, if they are told; they do not hold for the tree.
    """
    if table not in TABLES:
        raise ValueError(f"table must be one of {', '.join(TABLES)}")
    register(spark)
    wanted = {"sessions": None if sessions is None else list(sessions), "names": None if names is None else list(names), "low": first, "high": stop}
    return spark.read.format("session_files").options(table=table, wanted=json.dumps(wanted), **options).load(pattern)


# one document per session


@dataclass
class Written(WriterCommitMessage):
    files: list


class _Document:
    """One session's document, written as rows come: JSON keeps time stamps aside until the values have ended."""

    def __init__(self, base: str, kind: str):
        self.path, self.kind, self.n = f"{base}.{kind}", kind, 0
        self.out = open(self.path, "w", newline="")
        self.aside = open(f"{base}.aside", "w+") if kind == "json" else None
        self.out.write('{"data":[' if self.aside else "frame_seq,timestamp,value\n")

    def add(self, seq: list, stamps: list, values: list) -> None:
        if self.aside:
            for out, part in ((self.out, values), (self.aside, stamps)):
                out.write("," * bool(self.n) + json.dumps(part, separators=(",", ":"))[1:-1])
        else:
            text = lambda v: "" if v is None else str(v)
            stamp = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n\r') else v
            self.out.writelines(f"{s},{stamp(text(t))},{text(v)}\n" for s, t, v in zip(seq, stamps, values, strict=True))
        self.n += len(seq)

    def close(self) -> None:
        if self.aside:
            self.out.write('],"timestamps":[')
            self.aside.seek(0)
            shutil.copyfileobj(self.aside, self.out)
            self.out.write("]}")
            self.aside.close()
            os.remove(self.aside.name)
        self.out.close()


class SessionWriter(DataSourceArrowWriter):
    """Rows of a task come sorted by session and frame; a session is in one task."""

    def __init__(self, path: str, kind: str, overwrite: bool):
        self.path, self.kind, self.overwrite = path, kind, overwrite
        self.work = f"{path}/_temporary-{uuids.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder = f"{self.work}/{uuids.uuid4().hex}"  # of this attempt alone
        os.makedirs(folder)
        files, now, document = [], None, None
        for batch in iterator:
            sessions = batch.column("uuid").to_pylist()
            cuts = [0, *(i for i in range(1, len(sessions)) if sessions[i] != sessions[i - 1]), len(sessions)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if document is None or sessions[a] != now:
                    if document is not None:
                        document.close()
                    now = sessions[a]
                    name = quote("null" if now is None else now, safe="")
                    document = _Document(f"{folder}/{name}", self.kind)
                    files.append((document.path, f"{self.path}/{name}.{self.kind}"))
                part = batch.slice(a, b - a)
                document.add(*(part.column(c).to_pylist() for c in ("frame_seq", "timestamp", "value")))
        if document is not None:
            document.close()
        return Written(files)

    def commit(self, messages) -> None:
        """All documents take their names; only what tasks that ended well have written counts."""
        os.makedirs(self.path, exist_ok=True)
        files = [f for m in messages if m is not None for f in m.files]
        if self.overwrite:
            for old in glob.glob(f"{glob.escape(self.path)}/*.{self.kind}"):
                os.remove(old)
        elif there := [to for _, to in files if os.path.exists(to)]:
            shutil.rmtree(self.work, ignore_errors=True)
            raise FileExistsError(there[0])
        for source, to in files:
            os.replace(source, to)
        shutil.rmtree(self.work, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.work, ignore_errors=True)


class SessionDocuments(DataSource):
    """Options: path (a folder on a path that driver and workers share), kind (csv or json)."""

    @classmethod
    def name(cls) -> str:
        return "session_documents"

    def schema(self) -> str:
        return "uuid string, frame_seq long, timestamp string, value double"

    def writer(self, schema, overwrite: bool) -> SessionWriter:
        kind = self.options.get("kind", "csv")
        if kind not in ("csv", "json"):
            raise ValueError("kind must be csv or json")
        return SessionWriter(self.options["path"].rstrip("/"), kind, overwrite)


def export_sessions(values: DataFrame, path: str, *, kind: str = "csv", overwrite: bool = False) -> None:
    """One CSV or JSON document per session (uuid, frame_seq, timestamp, value), in order of frames (IO9, IO10).

    A session is streamed by one task, which holds a batch of its rows at a
    time. A failed job leaves no document; a null session is named null.
    """
    register(values.sparkSession)
    rows = values.selectExpr("cast(uuid as string) AS uuid", "cast(frame_seq as long) AS frame_seq", "cast(timestamp as string) AS timestamp", "cast(value as double) AS value")
    sorted_ = rows.repartition("uuid").sortWithinPartitions("uuid", "frame_seq")
    sorted_.write.format("session_documents").option("kind", kind).mode("overwrite" if overwrite else "append").save(path)
