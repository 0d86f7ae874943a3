"""Exact inner-product search by dual cover trees.

Vectors are dealt into blocks of bounded size. Every block of queries meets every block
of data; the pair is searched by two cover trees, one over the queries and one over the
data, walked together: with centres q and p and covering radii r and s, no pair below
two nodes scores more than q.p + |q| s + |p| r + r s, so the pair is left as soon as that
is below the worst k-th score of the query group. Below a leaf of queries each query has its
own bound, with a radius of nothing, and sibling leaves are scored by one matrix product.

There are two rounds. In the first, every query block meets one data block of its size; the
k-th scores found there are floors that every other block starts from in the second. What
is found is merged for each query by score, then smaller id.

Centres of a tree node's children lie more than half its radius apart; there are at most
FANOUT of them, each the farthest point from those before it, and a point goes to the
nearest. Children of few points join the nearest larger one, so that no level falls apart
into single points; where only one is large, the node is cut in two between its first two
centres. A child's covering radius is the distance of its farthest point. Equal vectors of
a block are one point with all its ids, so a vector that fills a third of the table costs
as much as one.

Defined cases: rows with a null id, a null vector, or a vector with a null, NaN or
infinite component take no part; queries meet only vectors of their own length; rows
with the query's own id are no candidates for it; a repeated query row counts once; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import batch_of, query, saved, table

BLOCK = 4096
QUERIES = 512
LEAF = 64
FANOUT = 8
#: Query trees a task holds at once.
TREES = 32
#: Different vector lengths up to which their block counts are broadcast.
SIZES = 100_000
LOWEST = -np.iinfo(np.int64).max  # its negative is a number too


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    points: np.ndarray  # indices of all points below
    kids: list[Node] = field(default_factory=list)
    centres: np.ndarray | None = None  # of the kids, one row each
    radii: np.ndarray | None = None
    norms: np.ndarray | None = None


def cover_tree(vectors: np.ndarray, points: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """A cover tree over rows of vectors (float64 holding integers)."""
    points = np.arange(len(vectors)) if points is None else points
    root = _node(vectors, points, vectors[points].mean(axis=0))
    waiting = [root]
    while waiting:
        node = waiting.pop()
        if len(node.points) <= leaf or node.radius == 0:
            continue
        node.kids = [_node(vectors, points, vectors[centre]) for centre, points in _children(vectors, node, leaf)]
        node.centres = np.stack([k.centre for k in node.kids])
        node.radii = np.array([k.radius for k in node.kids])
        node.norms = np.linalg.norm(node.centres, axis=1)
        waiting += node.kids
    return root


def _children(vectors: np.ndarray, node: Node, leaf: int) -> list[tuple[int, np.ndarray]]:
    """(centre, points) of a node's children."""
    rows, half = vectors[node.points], node.radius / 2
    centres, gaps = [0], [_distances(rows, rows[0])]
    nearest = gaps[0].copy()
    while len(centres) < FANOUT and nearest.max() > half:
        centres.append(int(nearest.argmax()))
        gaps.append(_distances(rows, rows[centres[-1]]))
        nearest = np.minimum(nearest, gaps[-1])
    if len(centres) == 1:  # all points lie within half the radius of the first
        return [(node.points[0], node.points)]
    gaps = np.stack(gaps)
    large = np.flatnonzero(np.bincount(gaps.argmin(axis=0), minlength=len(centres)) >= leaf // 2)
    if len(large) > 1:
        side = gaps[large].argmin(axis=0)
        return [(node.points[centres[c]], node.points[side == i]) for i, c in enumerate(large)]
    order = np.argsort(gaps[0] - gaps[1], kind="stable")
    cut = len(order) // 2
    return [(node.points[centres[0]], node.points[order[:cut]]), (node.points[centres[1]], node.points[order[cut:]])]


def _node(vectors: np.ndarray, points: np.ndarray, centre: np.ndarray) -> Node:
    return Node(centre, float(_distances(vectors[points], centre).max()), points)


def _distances(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """A little more than the Euclidean distances, so that rounding never shortens one."""
    gap = np.sqrt(((rows - centre) ** 2).sum(axis=1))
    return gap * (1 + 1e-12)


class Best:
    """The k best (score, id) of each query of a block; floors: scores that k others are known to reach."""

    def __init__(self, ids: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.own, self.k = ids, k
        self.score = np.full((len(ids), k), LOWEST, np.int64)
        self.id = np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)
        self.limit = np.full(len(ids), LOWEST, np.int64) if floors is None else floors.copy()

    def worst(self, queries: np.ndarray) -> int:
        return int(self.limit[queries].min())

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores[i, j]: of query queries[i] and the data row ids[j]."""
        scores = np.where(self.own[queries][:, None] == ids[None, :], LOWEST, scores)
        fits = scores >= np.maximum(self.limit[queries], LOWEST + 1)[:, None]
        rows, columns = fits.any(axis=1), fits.any(axis=0)
        if not rows.any():
            return
        queries, ids = queries[rows], ids[columns]
        scores = np.where(fits, scores, LOWEST)[rows][:, columns]
        ids = np.where(scores == LOWEST, np.iinfo(np.int64).max, np.broadcast_to(ids, scores.shape))
        all_scores = np.concatenate((self.score[queries], scores), axis=1)
        all_ids = np.concatenate((self.id[queries], ids), axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, :self.k]
        self.score[queries] = np.take_along_axis(all_scores, order, axis=1)
        self.id[queries] = np.take_along_axis(all_ids, order, axis=1)
        self.limit[queries] = np.maximum(self.limit[queries], self.score[queries, -1])


def dual_search(queries: np.ndarray, query_tree: Node, data: np.ndarray, data_tree: Node, ids: list[np.ndarray],
                best: Best, chunk: int = 512) -> int:
    """Put the best of data into best; ids[i]: the ids of data row i, at most k + 1 ascending. Inner products computed, those of bounds too."""
    computed = 0
    many, lengths = np.array([len(x) for x in ids]), np.linalg.norm(queries, axis=1)

    def over(top: np.ndarray) -> np.ndarray:
        nonlocal computed
        computed += top.size
        return top + 1e-9 * np.abs(top) + 1e-6

    def score(rows: np.ndarray, points: np.ndarray) -> None:
        nonlocal computed
        computed += len(rows) * len(points)
        products = np.rint(queries[rows] @ data[points].T).astype(np.int64)
        best.add(rows, np.repeat(products, many[points], axis=1), np.concatenate([ids[p] for p in points]))

    def below(rows: np.ndarray, top: Node) -> None:
        """A query leaf against a data node: from here on each of its queries has a bound of its own."""
        if not top.kids:
            score(rows, top.points)
            return
        inner = [(rows, top)]
        while inner:
            rows, node = inner.pop()
            tops = over(queries[rows] @ node.centres.T + lengths[rows, None] * node.radii)
            order = np.argsort(-tops.max(axis=0), kind="stable").tolist()
            outer = [i for i in order if not node.kids[i].kids]
            while outer:  # leaves are scored together, best bounds first
                need = tops >= best.limit[rows, None]
                taken, size = [], 0
                while outer and size < chunk:
                    i = outer.pop(0)
                    if need[:, i].any():
                        taken.append(i)
                        size += len(node.kids[i].points)
                if taken:
                    score(rows[need[:, taken].any(axis=1)], np.concatenate([node.kids[i].points for i in taken]))
            need = tops >= best.limit[rows, None]
            inner += [(rows[need[:, i]], node.kids[i]) for i in reversed(order) if node.kids[i].kids and need[:, i].any()]

    waiting = [(np.inf, query_tree, data_tree)]
    while waiting:
        bound, q, d = waiting.pop()
        if bound < best.worst(q.points):
            continue
        if not q.kids:
            below(q.points, d)
        elif d.kids and d.radius >= q.radius:
            norm = float(np.linalg.norm(q.centre))
            tops = over(d.centres @ q.centre + norm * d.radii + d.norms * q.radius + q.radius * d.radii)
            waiting += sorted(((t, q, kid) for t, kid in zip(tops.tolist(), d.kids)), key=lambda x: x[0])
        else:
            norm = float(np.linalg.norm(d.centre))
            tops = over(q.centres @ d.centre + norm * q.radii + q.norms * d.radius + d.radius * q.radii)
            waiting += sorted(((t, kid, d) for t, kid in zip(tops.tolist(), q.kids)), key=lambda x: x[0])
    return computed


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, size, vector): the rows that take part, components as floor(scale * x)."""
    x = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.where(fine).select(
        F.col(id_col).cast("long").alias("id"), F.size(x).alias("size"),
        F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long")).alias("vector"))


def block_counts(rows: DataFrame, count) -> DataFrame:
    """(size, blocks): few rows, one for each length of vectors; broadcast once that is known."""
    many, _ = saved(rows.groupBy("size").agg(count.alias("blocks")), "vector-sizes")
    return F.broadcast(many) if many.count() <= SIZES else many


def blocks(rows: DataFrame, bound: int, *more: str) -> DataFrame:
    """(size, block, ids, vectors, *more): rows in blocks of about `bound`, ids, components and further columns as arrays."""
    placed = rows.join(block_counts(rows, F.ceil(F.count("*") / bound)), "size").withColumn(
        "block", F.pmod(F.xxhash64("id", "vector"), F.col("blocks")).cast("int"))
    return placed.groupBy("size", "block").agg(
        F.collect_list("id").alias("ids"), F.flatten(F.collect_list("vector")).alias("vectors"),
        *[F.collect_list(c).alias(c) for c in more])


def search(data: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): the k best of each data block for the query blocks sent to it, if not below their floors.

    asked: size, block (of the data), query_block, query_ids, query_vectors, floor (an array).
    """
    pairs = data.join(asked, ["size", "block"]).select(
        "size", "block", "ids", "vectors", "query_block", "query_ids", "query_vectors", "floor")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asks = None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                size, block, group = (batch.column(i)[row].as_py() for i in (0, 1, 4))
                if held != (size, block):
                    held = (size, block)
                    ids, flat = (batch.column(i)[row].values.to_numpy() for i in (2, 3))
                    points, back = np.unique(flat.reshape(len(ids), size), axis=0, return_inverse=True)
                    order = np.lexsort((ids, back.ravel()))
                    cuts = np.searchsorted(back.ravel()[order], np.arange(1, len(points)))
                    # Of equal vectors only the smallest ids can be among the k best, one being the query's own.
                    names = [np.unique(x)[:k + 1] for x in np.split(ids[order], cuts)]
                    points = points.astype(np.float64)
                    tree = cover_tree(points)
                query_ids, query_flat, floors = (batch.column(i)[row].values.to_numpy() for i in (5, 6, 7))
                if (size, group) not in asks:
                    if len(asks) == TREES:
                        asks.pop(next(iter(asks)))
                    wanted = query_flat.reshape(len(query_ids), size).astype(np.float64)
                    asks[size, group] = wanted, cover_tree(wanted)
                best = Best(query_ids, k, floors)
                dual_search(*asks[size, group], points, tree, names, best)
                real = best.score > LOWEST
                yield batch_of({
                    "query_id": (np.repeat(query_ids, real.sum(axis=1)), pa.int64()),
                    "id": (best.id[real], pa.int64()), "score": (best.score[real], pa.int64())})

    return pairs.mapInArrow(walk, "query_id bigint, id bigint, score bigint")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best different ids of each query, with their rank."""
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 1024) -> DataFrame:
    """(query_id, rank, id, score): the k best rows of vectors for every row of queries."""
    data, _ = saved(blocks(scaled(vectors, id_col, vector_col, scale), BLOCK), "vector-blocks")
    targets = block_counts(data, F.max("block") + 1)
    asked, _ = saved(scaled(queries, id_col, vector_col, scale).dropDuplicates(["id", "vector"]), "queries")

    def sent(rows: DataFrame) -> DataFrame:
        """Query blocks with the number of data blocks of their size."""
        return blocks(rows, QUERIES, "floor").select(
            "size", F.col("block").alias("query_block"), F.col("ids").alias("query_ids"),
            F.col("vectors").alias("query_vectors"), "floor").join(targets, "size")

    home = F.pmod(F.col("query_block"), F.col("blocks")).cast("int")
    first, _ = saved(search(data, sent(asked.withColumn("floor", F.lit(LOWEST))).withColumn("block", home), k), "top-k-first")
    floors = best_of(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    known = asked.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(LOWEST)))
    # A stated query set against all rows, in blocks: each query block goes to every other data block of its size.
    others = sent(known).withColumn("home", home).withColumn(
        "block", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))).where("block <> home")
    return best_of(first.unionByName(search(data, others, k)), k).select("query_id", "rank", "id", "score")


@query("op9_exact_top_k", """
 WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
   CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
 r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
 SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op9_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 100 = 0")).withColumnRenamed("id", "vec_id")
