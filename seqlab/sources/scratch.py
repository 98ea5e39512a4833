"""Tables written in the folder that the cluster shares, to cut the lineage of work in rounds.

A lost executor then costs a task and not the whole chain. The folder is the
one named by ``spark.checkpoint.dir``; a session on one machine may do without.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by a session on one machine that names no shared folder, as in tests.
DEFAULT_SHARED = "/tmp/checkpoints"

_made: dict[str, None] = {}


def filesystem(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path as it knows it)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that does not exist yet; it goes with its ``scope``, or when the driver ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    _, root = filesystem(spark, (named or DEFAULT_SHARED).rstrip("/"))
    path = f"{root.toString()}/seqlab-{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_at_exit)
    _made[path] = None
    return path


def delete(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)
    _made.pop(path, None)


def _at_exit() -> None:
    session = SparkSession.getActiveSession()
    for path in list(_made) if session else []:
        try:
            delete(session, path)
        except Exception:  # the JVM may have gone first; the tables are only left behind
            return


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables saved within the scope are deleted at its end, when what needs them has been written."""
    before = set(_made)
    try:
        yield
    finally:
        for path in [p for p in _made if p not in before]:
            delete(spark, path)


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, *, max_rows: int = 200_000, max_bytes: int = 1 << 26) -> DataFrame:
    """A written or narrow table with a broadcast hint if its rows and bytes (as JSON) are within the bounds, else as it is."""
    small = df.count() <= max_rows and (df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= max_bytes
    return F.broadcast(df) if small else df
