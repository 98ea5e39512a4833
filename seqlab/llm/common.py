"""Helpers shared by the training-data operators.

* ``scratch`` / ``saved`` - written tables in the folder the cluster shares
  (``spark.checkpoint.dir``); they cut lineage, so that a lost executor costs
  one task and not the whole chain.
* ``broadcast_if_small`` - a broadcast behind a count of rows and bytes; larger sides are
  joined by a shuffle.
* ``sorted_runs`` - rows of equal key from sorted Arrow batches.
* ``ascii_words`` - the word rule of all operators here: A-Z lower-cased, words
  are maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by a session on one machine that names no shared folder, as in tests.
DEFAULT_SHARED = "/tmp/checkpoints"

#: The bytes that separate words, after A-Z have been lower-cased.
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TO_SPACE = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))

#: The same words as a Java regex of separators, for text not yet lower-cased.
SEPARATOR_REGEX = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_made: dict[str, None] = {}


def qualified(spark: SparkSession, path: str) -> str:
    """A path as a URI; without a scheme it is one of the cluster's default file system, for Spark and for tasks alike."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only a session on one machine may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return qualified(spark, named or DEFAULT_SHARED).rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; removed by ``discard``, or when the driver ends."""
    path = f"{shared_dir(spark)}/seqlab-{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made[path] = None
    return path


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _made.pop(path, None)


def scratch_paths() -> list[str]:
    """The scratch paths there are, in the order in which they were made."""
    return list(_made)


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete scratch paths that nothing reads any more."""
    _delete(spark, [p for p in paths if p in _made])


def _clean() -> None:
    session = SparkSession.getActiveSession()
    if session is None:
        return
    try:
        _delete(session, scratch_paths())
    except Exception:  # the JVM may have gone first; scratch tables are only left behind
        pass


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int, max_bytes: int = 1 << 28) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows and about ``max_bytes`` bytes (as JSON), else as it is.

    ``df`` should be a written or narrow table: it is counted, and its rows are
    measured if they are few enough.
    """
    small = df.count() <= max_rows and (df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= max_bytes
    return (F.broadcast(df) if small else df), small


def ascii_words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, as UTF-8; null has none."""
    return text.encode().lower().translate(_TO_SPACE).split() if text else []


def sorted_runs(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Rows of equal keys, from batches that are sorted by ``keys`` (no nulls in them)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def unused(name: str, taken: Sequence[str]) -> str:
    """``name``, with underscores in front until no column in ``taken`` has it (names differ by more than case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
