"""What the training-data operators share: the query registry, table reads and scratch tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register (spark, folder) -> DataFrame, with its check SQL where there is one."""
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def saved(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df under the shared folder and read it back; also the path, for `discard`."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove scratch tables that nothing reads any more."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def make_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)


def row_key(id_col: str, text_col: str):
    """Hash that tells rows with the same id apart; rows equal in id and text share it."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else changed."""
    # lower() is far cheaper than translate(), and equal unless other letters have a lower case.
    other = text.rlike(r"[\p{javaUpperCase}\p{javaTitleCase}&&[^A-Z]]")
    return F.when(other, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def sql_crc32(text: str) -> str:
    """DuckDB: the unsigned CRC-32 of a string's UTF-8 bytes, which it has no function for."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: {bits}), 4294967295)"


def batch_of(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    """A record batch from Python lists and their Arrow types."""
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=kind) for values, kind in columns.values()], names=list(columns))


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of few rows, so that whole texts of a slice stay small in memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_batches(batches: Iterator[pa.RecordBatch], column: int, rows: int = 1024, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows, and of about so many bytes of text unless one row has more."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            begun = int(ends[at - 1]) if at else 0
            end = min(max(at + 1, int(np.searchsorted(ends, begun + size, "right"))), at + rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
