"""Token-id files with directly addressable codes.

A file holds the ids of a run of documents. An id is cut into chunks of CHUNK bits, the
lowest first. Level k stores the k-th chunk of every id that has one, one chunk a byte,
with a bitmap that tells which of them go on to level k + 1. The place of an id in the
next level is the number of set bits before it, its rank, which a directory of running
counts every RANK_STEP bits gives after counting within one step. So any single id can
be read without decoding others.

Layout, little-endian: magic "DAC1", then unsigned 64-bit numbers: documents, ids, levels,
length of every level; the end (in ids, from the file's start) of every document; then
for each level its chunks, its bitmap and its rank directory of unsigned 64-bit counts.
Document numbers are stored as one Arrow stream ahead of that, its length first.

Files are written by the tasks, through Arrow's file systems, into the shared folder,
each under a fresh name; only those named in the written manifest count, so a task that
ran twice does no harm. Ranges of documents are dealt by id and row hash, so that files
follow each other in ascending id order.

Defined cases: a null text is empty and holds the end id only; repeated rows are
documents each, in any order among themselves as they are equal; null ids come first; an
empty table writes no file and reads back as no rows; extra columns are not stored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import fresh_path
from .common import make_folder, query, row_key, saved, small_batches, table, text_batches
from .tokens import default_tokenizer, encoder

MAGIC = b"DAC1"
CHUNK = 8
RANK_STEP = 512
#: Ids a file holds before the next one is begun.
FILE_IDS = 1 << 23


def pack_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, rank directory) of every level."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest) or not levels:
        more = rest >> np.uint32(CHUNK)
        on = more > 0
        bitmap = np.packbits(on, bitorder="little")
        set_bits = np.bitwise_count(bitmap)
        steps = np.add.reduceat(set_bits, np.arange(0, len(bitmap), RANK_STEP // 8), dtype=np.uint64) if len(on) else np.empty(0, np.uint64)
        ranks = np.concatenate((np.zeros(1, np.uint64), np.cumsum(steps, dtype=np.uint64)))[:max(1, len(steps))]
        levels.append(((rest & np.uint32((1 << CHUNK) - 1)).astype(np.uint8), bitmap, ranks))
        rest = more[on]
    return levels


class TokenFile:
    """Reads the bytes of a file: any id, any document, or everything."""

    def __init__(self, data: bytes):
        names = struct.unpack_from("<Q", data)[0]
        self.doc_ids = pa.ipc.open_stream(data[8:8 + names]).read_all().column(0)
        at = 8 + names
        if data[at:at + 4] != MAGIC:
            raise ValueError("not a token file")
        documents, self.n_ids, count = struct.unpack_from("<QQQ", data, at + 4)
        lengths = struct.unpack_from(f"<{count}Q", data, at + 28)
        at += 28 + 8 * count
        self.ends = np.frombuffer(data, "<u8", documents, at).astype(np.int64)
        at += 8 * documents
        self.levels = []
        for n in lengths:
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            bitmap = np.frombuffer(data, np.uint8, -(-n // 8), at)
            at += len(bitmap)
            ranks = np.frombuffer(data, "<u8", max(1, -(-n // RANK_STEP)), at).astype(np.int64)
            at += 8 * len(ranks)
            self.levels.append((chunks, bitmap, ranks))

    def token(self, place: int) -> int:
        """The id at a place, by one step a level."""
        value, shift = 0, 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[place]) << shift
            if not bitmap[place >> 3] >> (place & 7) & 1:
                return value
            step = place // RANK_STEP
            inside = bitmap[step * RANK_STEP // 8:(place >> 3) + 1].copy()
            inside[-1] &= (1 << (place & 7)) - 1
            place, shift = int(ranks[step]) + int(np.bitwise_count(inside).sum()), shift + CHUNK
        raise ValueError("the last level goes on")

    def document(self, number: int) -> list[int]:
        start = int(self.ends[number - 1]) if number else 0
        return [self.token(i) for i in range(start, int(self.ends[number]))]

    def ids(self) -> np.ndarray:
        """All ids, level by level."""
        value, places = self.levels[0][0].astype(np.uint32), None
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            if k:
                value[places] |= chunks.astype(np.uint32) << np.uint32(CHUNK * k)
            on = np.flatnonzero(np.unpackbits(bitmap, count=len(chunks), bitorder="little"))
            places = on if places is None else places[on]
        return value


def file_bytes(doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", doc_ids.type)])) as stream:
        stream.write_batch(pa.RecordBatch.from_arrays([doc_ids], names=["id"]))
    names = sink.getvalue().to_pybytes()
    levels = pack_levels(ids)
    head = MAGIC + struct.pack(f"<QQQ{len(levels)}Q", len(lengths), len(ids), len(levels), *(len(x[0]) for x in levels))
    body = [part.astype(part.dtype.newbyteorder("<")).tobytes() for level in levels for part in level]
    return b"".join([struct.pack("<Q", len(names)), names, head, np.cumsum(lengths).astype("<u8").tobytes(), *body])


def put(folder: str, name: str, data: bytes) -> None:
    """Write one file whole: under another name first, then moved."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/.{name}") as out:
        out.write(data)
    system.move(f"{path}/.{name}", f"{path}/{name}")


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
                      tokenizer: str | None = None) -> DataFrame:
    """Encode docs in ascending id order into files under folder; the written manifest.

    Manifest: part and file number (their order is that of the ids), name, documents, ids.
    """
    path = tokenizer or default_tokenizer()
    make_folder(docs.sparkSession, folder)
    end = end_id.to_bytes(4, "little")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col(id_col), row_key(id_col, text_col).alias("__row"), F.col(text_col))
    ordered = keyed.repartitionByRange(parts, id_col, "__row").sortWithinPartitions(id_col, "__row")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path).encode, TaskContext.get().partitionId()
        names, texts, held, number = [], [], 0, 0

        def done():
            ids = np.frombuffer(b"".join(texts), "<u4")
            name = f"{part:06d}-{number:06d}-{uuid.uuid4().hex}.dac"
            put(folder, name, file_bytes(pa.concat_arrays(names), np.array([len(t) // 4 for t in texts], np.int64), ids))
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([number]), pa.array([name]), pa.array([len(texts)]), pa.array([len(ids)])],
                names=["part", "file", "name", "documents", "ids"])

        for batch in text_batches(batches, 2):
            names.append(batch.column(0))
            coded = [ids + end for ids in encode(batch.column(2).to_pylist())]
            texts += coded
            held += sum(map(len, coded)) // 4
            if held >= FILE_IDS:
                yield done()
                names, texts, held, number = [], [], 0, number + 1
        if texts:
            yield done()

    manifest = ordered.mapInArrow(write, "part bigint, file bigint, name string, documents bigint, ids bigint")
    return saved(manifest, "token-manifest")[0]


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame, id_type: str = "bigint",
                     id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of every document; ids are little-endian unsigned 32-bit.

    start counts the ids of all documents before it: those of earlier files, from the
    manifest's counts, and those before it in its file.
    """
    in_part = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = manifest.groupBy("part").agg(F.sum("ids").alias("n"))  # one row a partition
    before = totals.select("part", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("base"))
    bases = manifest.join(F.broadcast(before), "part").select(
        "name", (F.col("base") + F.coalesce(F.sum("ids").over(in_part), F.lit(0))).alias("base"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    named = files.join(bases, "name").select("base", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                file = TokenFile(content.as_py())
                raw, ends = file.ids().astype("<u4").tobytes(), file.ends
                starts = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
                yield from small_batches(iter([pa.RecordBatch.from_arrays(
                    [file.doc_ids.combine_chunks() if isinstance(file.doc_ids, pa.ChunkedArray) else file.doc_ids,
                     pa.array(base + starts), pa.array(ends - starts),
                     pa.array([raw[4 * a:4 * b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())],
                    names=[id_col, "start", "n_tokens", "ids"])]), 1024)

    return named.mapInArrow(read, f"`{id_col}` {id_type}, start bigint, n_tokens bigint, ids binary")


@query("op5_token_files")
def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    place = fresh_path(spark, "token-files")
    manifest = write_token_files(table(spark, folder, "documents"), place)
    return read_token_files(spark, place, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
