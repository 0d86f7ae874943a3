"""Sums over columns x columns, added up inside tasks as matrices.

A pass over a table gives one matrix per task; what is shuffled and what reaches the
driver is the size of the result, whatever the number of rows, and the plan does not
grow with the number of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import SMALL_ROWS, materialize
from .ordered import Balance, running_totals

#: Rows turned into a matrix at once.
SLICE = 2048


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(values with 0 for NULL, mask of what is there) of slices of an array column."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            lists = batch.column(0).slice(at, SLICE)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)
            mask = ~np.isnan(flat)
            yield np.where(mask, flat, 0.0), mask


def summed(df: DataFrame, array, shapes: Mapping[str, tuple[int, ...]],
           add: Callable[[np.ndarray, np.ndarray], Mapping[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Named arrays: the sum of add(values, mask) over all slices of an array column."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {name: np.zeros(shape) for name, shape in shapes.items()}
        for values, mask in blocks(batches):
            for name, part in add(values, mask).items():
                held[name] += part
        for name, part in held.items():
            flat = part.ravel()
            used = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used), pa.string()), pa.array(used), pa.array(flat[used])], names=["name", "at", "v"])

    parts = df.select(array.alias("x")).mapInArrow(total, "name string, at bigint, v double")
    out = {name: np.zeros(int(np.prod(shape))) for name, shape in shapes.items()}
    for row in parts.groupBy("name", "at").agg(F.sum("v").alias("v")).collect():
        out[row["name"]][row["at"]] = row["v"]
    return {name: flat.reshape(shapes[name]) for name, flat in out.items()}


def vector(columns: Sequence[str], shifts: Mapping[str, float] | None = None):
    shifts = shifts or {}
    return F.array(*[F.col(c).cast("double") - F.lit(float(shifts.get(c) or 0.0)) for c in columns])


def pair_moments(df: DataFrame, columns: Sequence[str]) -> dict[str, np.ndarray]:
    """Over the rows where both columns of a pair have values: n, sums, squares and products, less the means.

    sums[i, j] and squares[i, j] are those of column i.
    """
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).head().asDict()
    k = len(columns)

    def add(x, m):
        m = m.astype(float)
        return {"n": m.T @ m, "sums": x.T @ m, "squares": (x * x).T @ m, "products": x.T @ x}

    return summed(df, vector(columns, means), dict.fromkeys(("n", "sums", "squares", "products"), (k, k)), add)


#: Spread below this share of the squares is that of a constant, up to rounding.
FLAT = 1e-11


def correlations(n, product, own, other, own_sum=0.0, other_sum=0.0):
    """Correlation from sums over n rows; NaN where either side is constant."""
    with np.errstate(divide="ignore", invalid="ignore"):
        va, vb = n * own - own_sum ** 2, n * other - other_sum ** 2
        r = (n * product - own_sum * other_sum) / np.sqrt(va * vb)
        return np.where((va > FLAT * n * own) & (vb > FLAT * n * other) & (n > 1), np.clip(r, -1, 1), np.nan)


def pair_table(df: DataFrame, columns: Sequence[str], r: np.ndarray, n: np.ndarray, name: str) -> DataFrame:
    """(var1, var2, name, n) of all pairs, var1 < var2."""
    place = {c: i for i, c in enumerate(columns)}
    rows = [(a, b, None if np.isnan(v := r[place[a], place[b]]) else float(v), int(n[place[a], place[b]]))
            for a, b in combinations(sorted(columns), 2)]
    return df.sparkSession.createDataFrame(rows, f"var1 string, var2 string, {name} double, n bigint")


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    m = pair_moments(df, columns)
    r = correlations(m["n"], m["products"], m["squares"], m["squares"].T, m["sums"], m["sums"].T)
    return pair_table(df, columns, r, m["n"], "r")


def null_patterns(n: np.ndarray) -> list[int]:
    """For each column the first column that is NULL in the same rows, from the counts of pairs."""
    k = len(n)
    return [next(j for j in range(i + 1) if n[i, i] == n[j, j] == n[i, j]) for i in range(k)]


#: Rows whose values are counted together in a task.
COUNTED_ROWS = 1 << 17


def value_counts(df: DataFrame, columns: Sequence[str], patterns: Sequence[int]) -> DataFrame:
    """(j, v, n0, n1, ...): rows with value v in column j, those where each pattern's column has a value.

    Tasks count large slices of rows, so that repeats fall together before the shuffle.
    """
    sums = [f"n{p}" for p in range(len(patterns))]

    def counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate(held)
        there = ~np.isnan(x)
        for j in range(x.shape[1]):
            own = there[:, j]
            v, code = np.unique(x[own, j], return_inverse=True)
            n = [np.bincount(code, there[own, p], len(v)).astype(np.int64) for p in patterns]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(v), j, np.int32)), pa.array(v), *map(pa.array, n)], names=["j", "v", *sums])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for values, mask in blocks(batches):
            held.append(np.where(mask, values, np.nan))
            rows += len(values)
            if rows >= COUNTED_ROWS:
                yield from counted(held)
                held, rows = [], 0
        if held:
            yield from counted(held)

    parts = df.select(vector(columns).alias("x")).mapInArrow(
        count, "j int, v double, " + ", ".join(f"{s} bigint" for s in sums))
    return parts.groupBy("j", "v").agg(*[F.sum(s).alias(s) for s in sums])


def mid_ranks(counts: DataFrame, k: int, width: int) -> DataFrame:
    """(j, v, ranks): the mean rank of each value of a column under each pattern."""
    sums = [f"n{p}" for p in range(width)]
    # Bounds from the distinct values, which are the rows that are put in order.
    names = [f"c{j}" for j in range(k)]
    balance = Balance.of(counts.select(*[F.when(F.col("j") == j, F.col("v")).alias(c) for j, c in enumerate(names)]), names)
    bucket = balance.bucket_in(F.element_at(F.array(*map(F.lit, names)), F.col("j") + 1), F.col("v"))
    return running_totals(counts, ["j"], "v", sums, bucket).select("j", "v", F.array(*[
        (F.col(f"{s}_before") + (F.col(s) + 1) / 2.0) for s in sums]).alias("ranks"))


def spearman(df: DataFrame, columns: Sequence[str], held: int = SMALL_ROWS) -> DataFrame:
    """Pairwise complete: a column is ranked once for each different null pattern of the others.

    Ranks start from counts of distinct values, one count for each pattern. Columns of few
    values, up to `held` values together, are ranked inside the tasks by a table of their
    values; the others by a join of (row, column, value). Pairs are sums of products of
    ranks. The rows are read several times, so they should be a written table.
    """
    k = len(columns)
    n = summed(df, vector(columns), {"n": (k, k)}, lambda x, m: {"n": m.T.astype(float) @ m})["n"]
    first = null_patterns(n)
    patterns = sorted(set(first))
    slot = np.array([patterns.index(j) for j in first])
    width = len(patterns)
    counts = materialize(value_counts(df, columns, patterns), "rank-counts")
    sizes = {r["j"]: r["count"] for r in counts.groupBy("j").count().collect()}
    inside, total = [], 0
    for j in sorted(sizes, key=lambda j: (sizes[j], j)):
        total += sizes[j]
        if total <= held:
            inside.append(j)
    joined = sorted(set(sizes) - set(inside))
    ranked = materialize(mid_ranks(counts, k, width), "ranks")
    few = ranked.where(F.col("j").isin(inside)).orderBy("j", "v").toArrow()
    of, values = (few.column(c).to_numpy() for c in ("j", "v"))
    ranks = few.column("ranks").combine_chunks().flatten().to_numpy().reshape(-1, width)
    tables = {j: (values[of == j], ranks[of == j]) for j in inside}
    middle = (n[:, patterns] + 1) / 2

    def add(x, m):
        # The values of all columns, then the ranks that a join found.
        own, found = m[:, :k], x[:, k:].reshape(len(x), len(joined), width)
        less = np.zeros((width, len(x), k))
        for j in range(k):
            if j in tables:
                known, by_value = tables[j]
                rank = by_value[np.minimum(np.searchsorted(known, x[:, j]), len(known) - 1)]
            elif j in joined:
                rank = found[:, joined.index(j)]
            else:
                continue
            for p, other in enumerate(patterns):
                less[p, :, j] = np.where(own[:, j] & own[:, other], rank[:, p] - middle[j, p], 0.0)
        products, squares = np.zeros((k, k)), np.zeros((k, k))
        for p in range(width):
            to = np.flatnonzero(slot == p)
            squares[:, to] = (less[p] * less[p]).sum(axis=0)[:, None]
            for q in range(width):
                by = np.flatnonzero(slot == q)
                products[np.ix_(by, to)] = less[p][:, by].T @ less[q][:, to]
        return {"products": products, "squares": squares}

    rows, flat = df, vector(columns)
    if joined:
        rows, flat = with_joined_ranks(df, columns, joined, ranked, width)
    s = summed(rows, flat, {"products": (k, k), "squares": (k, k)}, add)
    r = np.where((n > 1) & (s["squares"] > 0) & (s["squares"].T > 0),
                 s["products"] / np.sqrt(np.maximum(s["squares"] * s["squares"].T, 1e-300)), np.nan)
    return pair_table(df, columns, r, n, "rho")


def with_joined_ranks(df: DataFrame, columns: Sequence[str], joined: Sequence[int], ranked: DataFrame, width: int):
    """Rows, and the array of their values followed by their ranks in the joined columns."""
    # Column by column, which keeps the written table small; ids are fixed by writing them.
    rows = materialize(df.select(*[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)])
                       .withColumn("id", F.monotonically_increasing_id()), "ranked-rows")
    pairs = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"x{j}").alias("v")) for j in joined])).alias("p")
    long = rows.select("id", pairs).select("id", "p.*").where("v IS NOT NULL")
    found = long.join(ranked.where(F.col("j").isin(joined)), ["j", "v"]).groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("j", "ranks"))).alias("r"))
    nothing = F.array(*[F.lit(None).cast("double")] * width)
    parts = [F.coalesce(F.try_element_at("r", F.lit(j)), nothing) for j in joined]
    flat = F.concat(F.array(*[f"x{j}" for j in range(len(columns))]), *parts)
    return rows.join(found, "id", "left"), flat


def gram(df: DataFrame, columns: Sequence[str], intercept: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Products of all pairs over complete rows, and whether each column varies there.

    Columns are scaled by their largest magnitude, which leaves inflation factors as they are.
    """
    complete = df.na.drop(subset=list(columns))
    ends = complete.agg(*[f(F.col(c).cast("double")).alias(f"{t}{i}") for i, c in enumerate(columns) for t, f in (("a", F.min), ("b", F.max))]).head()
    low, high = (np.array([np.nan if ends[f"{t}{i}"] is None else ends[f"{t}{i}"] for i in range(len(columns))]) for t in "ab")
    most = np.where((m := np.maximum(np.abs(low), np.abs(high))) > 0, m, 1.0)
    k = len(columns) + int(intercept)

    def add(x, m):
        x = x / most
        if intercept:
            x = np.column_stack([x, np.ones(len(x))])
        return {"g": x.T @ x}

    return summed(complete, vector(columns), {"g": (k, k)}, add)["g"], low < high


def pair_counts(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """(var1, var2, a, b, n): rows by both levels of every pair of columns, NULLs left out.

    Values are coded by each column's levels; a task adds up one dense block for each pair.
    """
    columns = list(levels)
    codes = F.array(*[F.array_position(F.array(*map(F.lit, levels[c])), F.col(c).cast("string")).cast("double") for c in columns])
    size = 1 + max(len(v) for v in levels.values())
    pairs = list(combinations(range(len(columns)), 2))

    def add(x, m):
        codes = x.astype(np.int64)  # 0 where the value is missing
        return {"n": np.stack([
            np.bincount(codes[:, i] * size + codes[:, j], minlength=size * size) for i, j in pairs]).astype(float)}

    n = summed(df, codes, {"n": (len(pairs), size * size)}, add)["n"].reshape(-1, size, size)
    rows = [(columns[i], columns[j], levels[columns[i]][a - 1], levels[columns[j]][b - 1], int(n[p, a, b]))
            for p, (i, j) in enumerate(pairs) for a, b in zip(*np.nonzero(n[p])) if a and b]
    return df.sparkSession.createDataFrame(rows, "var1 string, var2 string, a string, b string, n bigint")
