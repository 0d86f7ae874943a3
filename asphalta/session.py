"""Session settings and the shared folder used for written tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """Session for tests and local benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("asphalta")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Joins on (accident, vehicle) may reuse a partitioning by accident.
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ASPHALTA_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as the session names it.

    Only a local-mode session, where driver and executors share one disk, may
    fall back to a folder made here.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="asphalta-")
    spark.conf.set(CHECKPOINT_CONF, made)
    return made


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has been written to yet."""
    return f"{shared_dir(spark)}/asphalta/{label}-{uuid.uuid4().hex}"


#: Rows up to which a table counts as small: about 100 MB at 100 bytes a row.
SMALL_ROWS = 1_000_000


def small_table(df: DataFrame, label: str, entries: Column | None = None) -> DataFrame:
    """A side table written once; broadcast in joins if its counted rows are few, else joined as it is.

    entries: the length of a row's array, where it has one; those count as rows.
    """
    table = materialize(df, label)
    size = F.count(F.lit(1)) if entries is None else F.count(F.lit(1)) + F.coalesce(F.sum(entries), F.lit(0))
    return F.broadcast(table) if table.agg(size).first()[0] <= SMALL_ROWS else table


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that are worth a task of their own where much is computed for each.
TASK_ROWS = 1 << 13


def spread(df: DataFrame) -> DataFrame:
    """df dealt over the cores there are, if it is read in fewer tasks and has rows enough for more.

    A written table of a few megabytes is read in one or two tasks, however much is
    computed for a row.
    """
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, df.count() // TASK_ROWS)
    return df.repartition(wanted) if wanted > df.rdd.getNumPartitions() else df
