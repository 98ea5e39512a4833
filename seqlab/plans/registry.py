"""The versioned cluster library (R1-R9, IO15, S5).

A library is a log of numbered commits on the cluster's file system. A commit
is a small JSON file that either comes into being whole or not at all, under a
number that no other commit has: of writers that want the same number one gets
it, and the others read the log again and retry. What a commit says is that a
version was saved (and where its Parquet tables are), archived or restored;
the state of the library is what the log says of each version last.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlab.sources.scratch import filesystem

SAVE, ARCHIVE, RESTORE = "save", "archive", "restore"
LOG = "_commits"

_VERSION = r"^v(\d+)\.(\d+)"


def parse_version(version: str | None) -> tuple[int, int]:
    """(major, minor) of vMAJOR.MINOR..., else (0, 0)."""
    m = re.match(_VERSION, version or "")
    return (int(m[1]), int(m[2])) if m else (0, 0)


def version_parts(version: Column) -> Column:
    """As ``parse_version``, for a column: struct(major, minor)."""
    part = lambda i: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(version, _VERSION, i), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    return F.struct(part(1).alias("major"), part(2).alias("minor"))


def successors(versions: DataFrame, *, by: Sequence[str] = (), version: str = "version") -> DataFrame:
    """(by, generated, added): the name after the newest version of each library, if it is generated or added to (R2).

    A generated library takes the next major number, an added one the next minor
    one; names that do not parse count as none, and v1.0 is the first.
    """
    known = F.when(F.col(version).rlike(_VERSION), version_parts(F.col(version)))
    newest = versions.groupBy(*by).agg(F.max(known).alias("_n"))
    major, minor = F.col("_n.major"), F.col("_n.minor")
    named = lambda a, b: F.when(F.col("_n").isNull(), "v1.0").otherwise(F.concat(F.lit("v"), a.cast("string"), F.lit("."), b.cast("string")))
    return newest.select(*by, named(major + 1, F.lit(0)).alias("generated"), named(major, minor + 1).alias("added"))


def retention(versions: DataFrame, *, keep: int = 3) -> DataFrame:
    """Adds ``status`` (R4, R7): Original, Preserved for the newest ``keep`` others, else Archived. ``versions``: version, is_original."""
    parts = version_parts(F.col("version"))
    v = versions.withColumn("_v", parts)
    newest = F.row_number().over(Window.partitionBy("is_original").orderBy(F.desc("_v.major"), F.desc("_v.minor")))
    return v.withColumn("status", F.when(F.col("is_original"), "Original").when(newest <= keep, "Preserved").otherwise("Archived")).drop("_v")


def replay(commits: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """(by, version, n_commits, archived): the state that a log leads to (R4, R8). ``commits``: by, seq, action, version.

    A version is there from its first save on; the last commit about it from
    then on tells whether it is archived. Versions without a save have no row.
    """
    saved = F.min(F.when(F.col("action") == SAVE, F.col("seq")))
    first = commits.groupBy(*by, "version").agg(saved.alias("_saved"), F.max_by("action", "seq").alias("_last"), F.count(F.lit(1)).alias("n_commits"))
    return first.where("_saved IS NOT NULL").select(*by, "version", "n_commits", (F.col("_last") == ARCHIVE).alias("archived"))


class Conflict(Exception):
    """Another writer took the commit's number."""


class Library:
    """A library at ``root``, a path of any file system that the cluster has.

    Commits are atomic where a rename to a name that exists fails (HDFS), and on
    local and mounted paths, by links. A store without either needs one writer.
    """

    def __init__(self, root: str, spark: SparkSession | None = None):
        self._spark = spark or SparkSession.getActiveSession()
        _, path = filesystem(self._spark, root)
        self.root = path.toString()

    # the log

    def _files(self, path: str):
        return filesystem(self._spark, path)

    def _read(self, path: str) -> str:
        fs, p = self._files(path)
        stream = fs.open(p)
        try:
            return self._spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commits(self, *, at: int | None = None) -> list[dict]:
        """The commits in order, up to the ``at``-th."""
        fs, p = self._files(f"{self.root}/{LOG}")
        if not fs.exists(p):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(p))
        found = [{"seq": int(n[:-5])} | json.loads(self._read(f"{self.root}/{LOG}/{n}")) for n in names if re.fullmatch(r"\d{20}\.json", n)]
        return [c for c in found if at is None or c["seq"] <= at]

    def _create(self, path: str, text: str) -> None:
        """A file with the text, whole, or Conflict if there is one of that name."""
        fs, target = self._files(path)
        part = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
        _, source = self._files(part)
        stream = fs.create(source, False)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        try:
            if fs.getUri().getScheme() == "file":  # a rename would replace the file there; a link does not
                try:
                    os.link(source.toUri().getPath(), target.toUri().getPath())
                except FileExistsError as e:
                    raise Conflict(path) from e
            elif fs.exists(target) or not fs.rename(source, target):
                raise Conflict(path)
        finally:
            fs.delete(source, False)

    def _commit(self, decide: Callable[[list[dict]], dict | None], *, tries: int = 50) -> dict | None:
        """The commit that ``decide`` makes of the log as it is; decided anew while another writer comes first. None commits nothing."""
        for n in range(tries):
            log = self.commits()
            entry = decide(log)
            if entry is None:
                return None
            seq = (log[-1]["seq"] if log else 0) + 1
            try:
                self._create(f"{self.root}/{LOG}/{seq:020d}.json", json.dumps(entry | {"created": datetime.now(timezone.utc).isoformat()}, indent=1))
                return {"seq": seq} | entry
            except Conflict:
                time.sleep(0.01 * n)
        raise Conflict(f"{self.root}: {tries} tries")

    @staticmethod
    def _state(log: list[dict]) -> dict[str, dict]:
        """By version: its save and whether it is archived now."""
        out: dict[str, dict] = {}
        for c in log:
            if c["action"] == SAVE:
                out.setdefault(c["version"], c | {"archived": False})
            elif c["version"] in out:
                out[c["version"]]["archived"] = c["action"] == ARCHIVE
        return out

    @staticmethod
    def _original(state: dict[str, dict]) -> str | None:
        """The first version that was generated, not added."""
        return next((v for v, c in state.items() if c["is_initial_library"]), None)

    def manifest(self, *, at: int | None = None) -> dict:
        """The library's versions in the order in which they were saved, as of now or of the ``at``-th commit."""
        log = self.commits(at=at)
        state = self._state(log)
        return {"versions": list(state.values()), "original_library": self._original(state), "last_updated": log[-1]["created"] if log else None}

    # versions

    def _next(self, log: list[dict], initial: bool) -> str:
        known = [parse_version(v) for v in self._state(log) if re.match(_VERSION, v)]
        if not known:
            return "v1.0"
        major, minor = max(known)
        return f"v{major + 1}.0" if initial else f"v{major}.{minor + 1}"

    def next_version(self, *, initial: bool) -> str:
        """v1.0 at first; a generated library takes the next major, an added one the next minor of the newest (R2)."""
        return self._next(self.commits(), initial)

    def save(self, tables: dict[str, DataFrame], *, initial: bool, normalization: str, features: list[str], keep: int = 3) -> str:
        """Write a version's tables, commit it under the next free name, then archive old ones (R3-R5, IO15).

        Tables are written once, in a folder of their own; a writer that comes
        second only takes a later name. A failed write commits nothing.
        """
        folder = f"{self.root}/library_{uuid.uuid4().hex}"
        try:
            for name, table in tables.items():
                table.write.mode("error").parquet(f"{folder}/{name}")
        except BaseException:
            fs, p = self._files(folder)
            fs.delete(p, True)
            raise
        entry = {"action": SAVE, "folder": os.path.basename(folder), "tables": sorted(tables), "normalization_type": normalization, "features": features, "is_initial_library": initial}
        version = self._commit(lambda log: entry | {"version": self._next(log, initial)})["version"]
        self.archive(keep=keep)
        return version

    def archive(self, *, keep: int = 3) -> list[str]:
        """Archive all but the original and the newest ``keep`` (R4); their tables stay where they are."""
        done = []
        while True:

            def oldest(log: list[dict]) -> dict | None:
                state = self._state(log)
                others = sorted((v for v, c in state.items() if not c["archived"] and v != self._original(state)), key=parse_version, reverse=True)
                return {"action": ARCHIVE, "version": others[-1]} if len(others) > keep else None

            entry = self._commit(oldest)
            if entry is None:
                return done
            done.append(entry["version"])

    def folder(self, version: str) -> str:
        """Where a version's tables are."""
        state = self._state(self.commits())
        if version not in state:
            raise FileNotFoundError(f"{self.root}: {version}")
        return f"{self.root}/{state[version]['folder']}"

    def load(self, spark: SparkSession, version: str) -> dict[str, DataFrame]:
        """The tables of a version that is not archived."""
        state = self._state(self.commits())
        if version not in state or state[version]["archived"]:
            raise FileNotFoundError(f"{self.root}: {version}")
        return {name: spark.read.parquet(f"{self.root}/{state[version]['folder']}/{name}") for name in state[version]["tables"]}

    def list_versions(self, spark: SparkSession, *, archived: bool = False) -> DataFrame:
        """version, created, status and whether it is archived, newest first."""
        state = self._state(self.commits())
        original = self._original(state)
        rows = [(v, c["created"], "Original" if v == original else "Archived" if c["archived"] else "Update", c["archived"]) for v, c in state.items() if archived or not c["archived"]]
        rows.sort(key=lambda r: parse_version(r[0]), reverse=True)
        return spark.createDataFrame(rows, "version string, created string, status string, archived boolean")

    def restore(self, version: str) -> str:
        """Bring an archived version back (R8); a missing leading v is added."""
        version = version if version.startswith("v") else f"v{version}"

        def back(log: list[dict]) -> dict | None:
            state = self._state(log)
            if version not in state or not state[version]["archived"]:
                raise FileNotFoundError(f"{self.root}: {version} is not archived")
            return {"action": RESTORE, "version": version}

        self._commit(back)
        return version
