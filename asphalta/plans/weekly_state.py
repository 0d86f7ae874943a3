"""Weekly sensor aggregates kept as counts, so that a new file is all that is read.

The value counts of every file are written once. A registry names, for each file, its
digest and the folder of its counts; it is a versioned table, so a run that fails leaves
the state as it was. Files of known size and time are not opened; others are counted only
if their digest is new, and a file that changed replaces its counts. Medians, rates and
weekly aggregates are derived from the stored counts of all files.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import traffic
from ..sources import streams
from ..sources.files import logical_name
from ..sources.snapshots import SnapshotTable

REGISTRY = "fichier_source string, longueur bigint, modifie timestamp, empreinte string, dossier string"


def digests(files: DataFrame) -> DataFrame:
    """files with the SHA-256 of their bytes, read by tasks a piece at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                total = hashlib.sha256()
                with streams.opened(path) as stream:
                    while piece := stream.read(streams.PIECE):
                        total.update(piece)
                found.append(total.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.string())], names=["path", "empreinte"])

    marks = files.select("path").repartition("path").mapInArrow(read, "path string, empreinte string")
    return files.join(marks, "path")


class WeeklyState:
    """Counts and registry under a folder; `read` makes typed readings of a list of paths.

    Readings have fichier_source (the file's name), iu_ac, t_1h, q and k.
    """

    def __init__(self, spark: SparkSession, path: str, read: Callable[[Sequence[str]], DataFrame]):
        self.spark, self.path, self._read = spark, path.rstrip("/"), read
        self._table = SnapshotTable(spark, f"{self.path}/registry")

    def registry(self) -> DataFrame:
        if not self._table.version:
            return self.spark.createDataFrame([], REGISTRY)
        return self._table.read()

    def update(self, folder: str) -> list[str]:
        """Take in the files under a folder; the paths that were read for it."""
        base = self._table.version
        known = self.registry().select(*[F.col(c).alias(f"_{c}") for c in ("fichier_source", "longueur", "modifie", "empreinte", "dossier")])
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(
            "path", logical_name(F.col("path")).alias("fichier_source"), F.col("length").alias("longueur"), F.col("modificationTime").alias("modifie"))
        met = listed.join(known, F.col("fichier_source") == F.col("_fichier_source"), "left")
        same = F.col("longueur").eqNullSafe(F.col("_longueur")) & F.col("modifie").eqNullSafe(F.col("_modifie"))
        touched = digests(met.where(~same)).select(
            "path", "fichier_source", "longueur", "modifie", "empreinte", F.col("_empreinte").alias("avant"), F.col("_dossier").alias("dossier"))
        rows = touched.orderBy("path").collect()  # names of new and touched files
        if not rows:
            return []
        fresh = [r for r in rows if r["empreinte"] != r["avant"]]
        made = uuid.uuid4().hex
        if fresh:
            counts = traffic.value_counts(self._read([r["path"] for r in fresh]))
            counts.write.parquet(f"{self.path}/counts/{made}")
        entries = [(r["fichier_source"], r["longueur"], r["modifie"], r["empreinte"], made if r["empreinte"] != r["avant"] else r["dossier"]) for r in rows]
        new = self.spark.createDataFrame(entries, REGISTRY)
        kept = self.registry().join(F.broadcast(new.select("fichier_source")), "fichier_source", "left_anti")
        self._table.write(kept.select(*new.columns).unionAll(new), base=base)
        return [r["path"] for r in fresh]

    def counts(self) -> DataFrame:
        """Value counts of all files, each as it was taken in last."""
        registry = self.registry().select("fichier_source", "dossier")
        folders = [r[0] for r in registry.select("dossier").distinct().collect()]  # one for each update
        if not folders:
            raise ValueError(f"no file was taken into {self.path}")
        stored = self.spark.read.parquet(*[f"{self.path}/counts/{d}" for d in folders])
        named = stored.withColumn("dossier", F.element_at(F.split("_metadata.file_path", "/"), -2))
        return named.join(registry, ["fichier_source", "dossier"], "left_semi").drop("dossier")

    def weekly(self) -> DataFrame:
        """One row per sensor and weekly file, as `traffic.weekly_aggregate` over all readings gives."""
        return traffic.weekly_of_counts(self.counts())

    def statistics(self) -> DataFrame:
        """Missing rates and medians per file and sensor, as `traffic.sensor_statistics` gives."""
        return traffic.per_sensor(traffic.running_counts(self.counts())).select(
            "fichier_source", "iu_ac", "q_missing_rate", "q_median", "k_median")
