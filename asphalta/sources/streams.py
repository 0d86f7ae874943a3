"""Lines of files that Spark's text source cannot tell apart, streamed inside tasks.

A file is a row of a path table, not of its content: tasks open their own files, so none
is opened on the driver, and a gzip file of any size passes through in pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PIECE = 1 << 20
#: Lines in a batch handed to Spark; with PIECE it bounds what a task holds.
LINES = 8192
MAGIC = b"\x1f\x8b"


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path) of all files below a folder that hold anything; they are listed, not read, and dealt to tasks."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return found.repartition("path")


def opened(path: str):
    """A stream of a file's bytes, by the file system that its path names."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem().open_input_stream("/" + path.removeprefix("file:").lstrip("/"))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_stream(inner, compression=None)


def pieces(stream) -> Iterator[bytes]:
    """Plain bytes of a stream, inflated where it is gzip, member after member."""
    data = stream.read(PIECE)
    if data[:2] != MAGIC:
        while data:
            yield data
            data = stream.read(PIECE)
        return
    engine = zlib.decompressobj(31)
    while data:
        out = engine.decompress(data, PIECE)
        data = engine.unconsumed_tail
        if engine.eof:
            data, engine = engine.unused_data, zlib.decompressobj(31)
        if out:
            yield out
        if not data:
            data = stream.read(PIECE)


def lines_of(stream, encoding: str = "utf-8") -> Iterator[str]:
    """Lines without their ends and without a byte-order mark."""
    rest, first = b"", True
    for piece in pieces(stream):
        *done, rest = (rest + piece).split(b"\n")
        for line in done:
            text = line.rstrip(b"\r").decode(encoding, "replace")
            yield text.removeprefix("﻿") if first else text
            first = False
    if rest:
        text = rest.rstrip(b"\r").decode(encoding, "replace")
        yield text.removeprefix("﻿") if first else text


def heads(files: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """(path, zipped, header): whether a file is gzip by its first bytes, and its first line."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, zipped, first = batch.column(0).to_pylist(), [], []
            for path in paths:
                with opened(path) as stream:
                    zipped.append(stream.read(2) == MAGIC)
                with opened(path) as stream:
                    first.append(next(lines_of(stream, encoding), ""))
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(zipped), pa.array(first)], names=["path", "zipped", "header"])

    return files.select("path").mapInArrow(look, "path string, zipped boolean, header string")


def streamed_lines(files: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """(path, value) lines of every file of a path table, gzip or not."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path) as stream:
                    held, size = [], 0
                    for line in lines_of(stream, encoding):
                        held.append(line)
                        size += len(line)
                        if len(held) >= LINES or size >= PIECE:
                            yield pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array(held)], names=["path", "value"])
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array(held)], names=["path", "value"])

    return files.select("path").mapInArrow(read, "path string, value string")
