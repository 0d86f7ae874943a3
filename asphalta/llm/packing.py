"""Best-fit packing after Martello-Toth reduction.

Only the counts of piece lengths, at most `capacity` rows, come to the driver. On them
the reduction fixes sets that provably dominate every alternative (a piece that fits
with nothing; a piece and its exact complement; a piece with the largest that fits when
no other feasible set is better; likewise a triple), many equal sets at a time. Best fit
in decreasing order packs the remainder, again by counts. What results is a list of
patterns (lengths and how many sequences are filled so): at most about four for each
length, however many pieces there are.

Pieces then find their place by rank among the pieces of equal length. Ranks are a
running number in the task that wrote the piece plus an offset from the counts of
earlier tasks, so no length, however frequent, is gathered or sorted in one task.

Defined cases: a null or empty text is one piece holding the end id; repeated rows and
null ids are pieces of their own; an empty table gives an empty result; other input
columns pass through `pack`, those named like its results give way.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .common import query, saved, table, text_batches
from .tokens import default_tokenizer, encoder

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, how many), ...), number of sequences


def largest_at_most(counts: np.ndarray) -> np.ndarray:
    """For every v the largest length <= v that is left, 0 if none."""
    return np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))


def dominating_set(counts: np.ndarray, j: int) -> tuple[int, ...] | None:
    """Lengths that go with one piece of length j in some best packing, if reduction can tell."""
    room = len(counts) - 1 - j
    rest = counts[:room + 1].copy()
    if j <= room:
        rest[j] -= 1
    sizes = np.flatnonzero(rest)
    if not len(sizes):
        return ()
    best = int(sizes[-1])
    if best == room:
        return (best,)
    smallest = np.repeat(sizes[:3], np.minimum(rest[sizes[:3]], 3))[:3]
    if len(smallest) < 2 or smallest[:2].sum() > room:
        return (best,)
    if len(smallest) == 3 and smallest.sum() <= room:
        return None
    # At most two pieces can go with j. y is the smaller of a pair, x the largest that then fits.
    at_most = largest_at_most(rest)
    x = at_most[room - sizes]
    alone = (x == sizes) & (rest[sizes] < 2)
    if alone.any():
        fewer = x[alone] - 1
        x[alone] = at_most[fewer]
    pairs = x >= sizes
    if not pairs.any():
        return (best,)
    sums = (x + sizes)[pairs]
    if best >= sums.max():
        return (best,)
    y = int(sizes[pairs].max())
    if best + y <= room and (y != best or rest[y] > 1):
        return (best, y)
    return None


def reduce_sizes(counts: np.ndarray) -> list[Pattern]:
    """Fix dominating sets, taking their pieces out of counts."""
    fixed: list[Pattern] = []
    for j in range(len(counts) - 1, 0, -1):
        while counts[j]:
            chosen = dominating_set(counts, j)
            if chosen is None:
                break
            need: dict[int, int] = defaultdict(int)
            for size in (j, *chosen):
                need[size] += 1
            times = min(int(counts[s]) // n for s, n in need.items())
            for s, n in need.items():
                counts[s] -= n * times
            fixed.append((tuple(sorted(need.items(), reverse=True)), times))
    return fixed


def best_fit(counts: np.ndarray) -> list[Pattern]:
    """Best fit in decreasing order, for all pieces of a length and all equal sequences at once."""
    capacity = len(counts) - 1
    open_at: dict[int, list[Pattern]] = defaultdict(list)

    def put(pattern, number, room, size, each):
        if number:
            open_at[room - size * each].append(((*pattern, (size, each)) if each else pattern, number))

    for size in range(capacity, 0, -1):
        left = int(counts[size])
        rooms = iter(sorted(r for r in open_at if r >= size and open_at[r]))
        while left:
            room = next(rooms, None)
            groups = open_at.pop(room) if room is not None else [((), -(-left // (capacity // size)))]
            room = capacity if room is None else room
            each = room // size
            for pattern, number in groups:
                full = min(number, left // each)
                put(pattern, full, room, size, each)
                left -= full * each
                part = left if full < number else 0
                put(pattern, int(part > 0), room, size, part)
                left -= part
                untouched = number - full - int(part > 0)
                if untouched:
                    open_at[room].append((pattern, untouched))
    return [group for groups in open_at.values() for group in groups]


def pack_sizes(sizes: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold sizes[length] pieces of every length, as few sequences as this method finds."""
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in sizes.items():
        if not 0 < size <= capacity:
            raise ValueError(f"a piece of length {size} can't be packed into {capacity}")
        counts[size] = n
    return reduce_sizes(counts) + best_fit(counts)


def slots_of(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, how many a sequence, first sequence, offset), sorted."""
    next_rank: dict[int, int] = defaultdict(int)
    first, rows = 0, []
    for pattern, number in patterns:
        offset = 0
        for size, each in pattern:
            rows.append((size, next_rank[size], each, first, offset))
            next_rank[size] += each * number
            offset += size * each
        first += number
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096,
                  end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids) of every piece; ids are little-endian unsigned 32-bit."""
    path = tokenizer or default_tokenizer()
    kind = docs.schema[id_col].dataType.simpleString()
    end, step = end_id.to_bytes(4, "little"), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in text_batches(batches, 1):
            texts = [ids + end for ids in encode(batch.column(1).to_pylist())]
            pieces = [(row, at, ids[at:at + step]) for row, ids in enumerate(texts) for at in range(0, len(ids), step)]
            rows, starts, ids = zip(*pieces) if pieces else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([a // step for a in starts], pa.int32()),
                 pa.array([a // 4 for a in starts], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array(ids, pa.binary())], names=[id_col, "piece", "start", "length", "ids"])

    return docs.select(id_col, text_col).mapInArrow(
        cut, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids binary")


def numbered(pieces: DataFrame) -> DataFrame:
    """pieces with __task and __rank, a running number among the pieces of equal length in the task."""
    place = pieces.columns.index("length")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(1, np.int64)
        for batch in batches:
            length = batch.column(place).to_numpy()
            if not len(length):
                continue
            if length.max() >= len(seen):
                seen = np.concatenate((seen, np.zeros(int(length.max()) + 1 - len(seen), np.int64)))
            order = np.argsort(length, kind="stable")
            inside = np.arange(len(order)) - np.searchsorted(length[order], length[order])
            rank = np.empty(len(order), np.int64)
            rank[order] = seen[length[order]] + inside
            np.add.at(seen, length, 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(rank), task, np.int32)), pa.array(rank)],
                names=[*batch.schema.names, "__task", "__rank"])

    added = [T.StructField("__task", T.IntegerType()), T.StructField("__rank", T.LongType())]
    return pieces.mapInArrow(number, T.StructType([*pieces.schema.fields, *added]))


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces (any columns, among them length) with sequence_id and offset."""
    spark = pieces.sparkSession
    ranked, _ = saved(numbered(pieces.drop("sequence_id", "offset")), "pieces")
    counts, _ = saved(ranked.groupBy("length", "__task").count(), "piece-counts")
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(slots_of(pack_sizes(totals, capacity)))
    earlier = Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "__task", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__base"))
    based = ranked.join(bases, ["length", "__task"]).select(
        *[F.col(c) for c in ranked.columns if not c.startswith("__")], (F.col("__base") + F.col("__rank")).alias("__rank"))
    place = based.columns.index("length")

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = slots.value
        lows = rows[:, 0] << 40 | rows[:, 1] if len(rows) and rows[:, 1].max() < 1 << 40 else None
        for batch in batches:
            length, rank = batch.column(place).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            if not len(length):
                continue
            at = rows[np.searchsorted(lows, length << 40 | rank, "right") - 1]
            inside = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(at[:, 3] + inside // at[:, 2]),
                 pa.array(at[:, 4] + inside % at[:, 2] * length)],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    added = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return based.mapInArrow(seat, T.StructType([*based.schema.fields[:-1], *added]))


def sequences(placed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per sequence: its token ids and its pieces in order; at most capacity tokens each."""
    piece = F.struct("offset", F.col(id_col).alias("doc_id"), "piece", "length", "ids")
    held = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("held"))
    return held.select(
        "sequence_id", F.aggregate("held", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("n_tokens"),
        F.transform("held", lambda p: p["doc_id"]).alias("doc_ids"),
        F.transform("held", lambda p: p["piece"]).alias("pieces"),
        F.transform("held", lambda p: p["offset"]).alias("offsets"),
        F.expr("unhex(array_join(transform(held, p -> hex(p.ids)), ''))").alias("ids"))


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = cut_documents(table(spark, folder, "documents"))
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
