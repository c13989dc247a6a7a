"""Tables in versions with one pointer: readers see the old table or the new one, never a mixture.

A version adds a folder ``data/version=N`` for the partitions it rewrites. Its list of live partitions
(which folder holds each) is written beside them, and last of all a small pointer file gets its name
by a rename, which is the commit. A writer that is killed before that leaves the table as it was.
Folders of older versions stay for readers that have begun, until ``vacuum`` removes what no kept
version lists. One writer at a time: a second one that starts from the same version raises.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "version"


class Conflict(RuntimeError):
    """Another writer has taken the next version."""


class Versions:
    """A table at ``path`` laid out by the columns ``by``."""

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str]):
        self.spark, self.path, self.by = spark, path.rstrip("/"), list(by)
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._jvm.Path("/".join((self.path, *parts)))

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _folders(self) -> list[int]:
        """Numbers of the data folders."""
        return [int(n.removeprefix(f"{VERSION}=")) for n in self._names("data") if n.startswith(f"{VERSION}=")]

    def committed(self) -> list[int]:
        """Versions that readers may see, oldest first."""
        return sorted(int(n) for n in self._names("commits") if n.isdigit())

    def latest(self) -> int | None:
        return max(self.committed(), default=None)

    def live(self, version: int) -> DataFrame:
        """Partitions of a version and the number of the data folder that holds each."""
        return self.spark.read.parquet(f"{self.path}/live/{version:012d}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, of the latest one by default. Folders that are not live are left out by
        the join with the list, which prunes partitions where it is small enough to be broadcast."""
        version = self.latest() if version is None else version
        if version is None:
            raise FileNotFoundError(f"no version has been committed at {self.path}")
        live, keys = self.live(version), [VERSION, *self.by]
        # Partition values keep the types that they were written with.
        found = self.spark.read.parquet(f"{self.path}/data").schema
        typed = T.StructType([live.schema[f.name] if f.name in keys else f for f in found])
        return self.spark.read.schema(typed).parquet(f"{self.path}/data").join(live, keys, "left_semi").drop(VERSION)

    def replace(self, rows: DataFrame, emptied: DataFrame | None = None, base: int | None = None) -> int:
        """Commit ``rows`` as the new content of the partitions that they and ``emptied`` name; all other
        partitions stay. ``base``: the version the rows were made from, the latest by default."""
        base = self.latest() if base is None else base
        new = (base or 0) + 1
        claim = self._at("claims", f"{new:012d}")
        if not self._fs.createNewFile(claim):
            raise Conflict(f"version {new} of {self.path} is being written")
        try:
            if self.latest() != base:
                raise Conflict(f"version {base} of {self.path} is no longer the latest")
            # Never a folder that was there before: killed writers leave some, and readers may have listed them.
            number = max(self._folders(), default=0) + 1
            folder = f"{self.path}/data/{VERSION}={number}"
            rows.hint("rebalance", *self.by).write.partitionBy(*self.by).parquet(folder)
            written = self.spark.read.schema(rows.schema).parquet(folder)
            touched = written.select(*self.by).distinct().select(F.lit(number).alias(VERSION), *self.by)
            if base is None:
                live = touched
            else:
                gone = touched.select(*self.by) if emptied is None else touched.select(*self.by).unionByName(emptied.select(*self.by)).distinct()
                live = self.live(base).join(gone, self.by, "left_anti").unionByName(touched)
            live.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/live/{new:012d}")
            self._point(new)
        finally:
            self._fs.delete(claim, False)
        return new

    def _point(self, version: int) -> None:
        """The commit: a file that is there whole or not at all."""
        draft = self._at("drafts", uuid.uuid4().hex)
        self._fs.create(draft, False).close()
        self._fs.mkdirs(self._at("commits"))
        if not self._fs.rename(draft, self._at("commits", f"{version:012d}")):
            raise Conflict(f"version {version} of {self.path} has been committed by another writer")

    def release(self) -> None:
        """Drop the claims of writers that were killed; only where no writer is running."""
        self._fs.delete(self._at("claims"), True)

    def update(self, change: Callable[[DataFrame], DataFrame], batch: DataFrame, first: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Replace the partitions that ``batch`` touches by ``change(their rows)``; ``first`` makes the rows
        of a table that has none."""
        base = self.latest()
        if base is None:
            return self.replace((first or (lambda b: b))(batch))
        touched = batch.select(*self.by).distinct()
        rows = self.read(base)
        return self.replace(change(rows.join(touched, self.by, "left_semi")), touched, base)

    def vacuum(self, keep: int = 2) -> list[int]:
        """Forget all but the last ``keep`` versions and delete data folders that none of them lists;
        returns the numbers of those folders. Not while a writer is running."""
        versions = self.committed()
        old, kept = versions[:-keep], versions[-keep:]
        for v in old:
            self._fs.delete(self._at("commits", f"{v:012d}"), False)
        listed: set[int] = set()
        for v in kept:
            listed |= {r[VERSION] for r in self.live(v).select(VERSION).distinct().collect()}  # folders, not partitions
        gone = [n for n in self._folders() if n not in listed]
        for number in gone:
            self._fs.delete(self._at("data", f"{VERSION}={number}"), True)
        for v in old:
            self._fs.delete(self._at("live", f"{v:012d}"), True)
        return sorted(gone)
