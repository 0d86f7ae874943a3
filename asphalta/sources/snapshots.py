"""Versioned tables: whole versions in folders of their own, and a pointer that moves at once.

A version is written to a new folder first and counts only when its number is taken in
the log folder, which one writer can do. So a table may be written from itself, a failed
write changes nothing, readers keep the version they opened, and of two writers that
started from the same version the second is told.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


class VersionTaken(RuntimeError):
    """Another writer has made the next version first."""


class SnapshotTable:
    """A Parquet table under a folder: `data/<folder>` for each version, `log/<number>` naming it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> dict[int, str]:
        """Folder of every version by its number; a pointer that is not written yet is none."""
        log = self._at(f"{self.path}/log")
        if not self._fs.exists(log):
            return {}
        out = {}
        for entry in self._fs.listStatus(log):
            name = entry.getPath().getName()
            if name.isdigit() and entry.getLen() > 0:
                out[int(name)] = self._text(entry.getPath())
        return dict(sorted(out.items()))

    def _text(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return stream.readUTF()
        finally:
            stream.close()

    @property
    def version(self) -> int:
        """Number of the current version, 0 where there is none."""
        return max(self.versions(), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        versions = self.versions()
        if not versions:
            raise FileNotFoundError(f"no version of {self.path}")
        return self.spark.read.parquet(f"{self.path}/data/{versions[version or max(versions)]}")

    def write(self, df: DataFrame, partition_by: Iterable[str] = (), keep_if_empty: bool = True, base: int | None = None) -> bool:
        """Make df the next version after `base`, by default after the one that is current now.

        An empty df leaves the table as it is unless keep_if_empty is off. df is computed once.
        """
        base = self.version if base is None else base
        folder = uuid.uuid4().hex
        target = f"{self.path}/data/{folder}"
        df.write.partitionBy(*partition_by).parquet(target)
        if keep_if_empty and self.spark.read.schema(df.schema).parquet(target).isEmpty():
            self._fs.delete(self._at(target), True)
            return False
        self._commit(base + 1, folder)
        return True

    def _commit(self, number: int, folder: str) -> None:
        place = self._at(f"{self.path}/log/{number:012d}")
        try:
            stream = self._fs.create(place, False)  # fails where the number is taken
        except Exception as error:
            if self._fs.exists(place):
                self._fs.delete(self._at(f"{self.path}/data/{folder}"), True)
                raise VersionTaken(f"version {number} of {self.path} is there already") from error
            raise
        stream.writeUTF(folder)
        stream.close()

    def drop_old(self, keep: int = 2) -> list[int]:
        """Remove all but the last `keep` versions and folders that never became one; the numbers removed.

        Not while a writer is at work: its folder is no version yet.
        """
        versions = self.versions()
        gone = sorted(versions)[:-keep] if keep else sorted(versions)
        for number in gone:
            self._fs.delete(self._at(f"{self.path}/log/{number:012d}"), False)
        kept = {folder for number, folder in versions.items() if number not in gone}
        data = self._at(f"{self.path}/data")
        for entry in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if entry.getPath().getName() not in kept:
                self._fs.delete(entry.getPath(), True)
        return gone
