"""Random forest with the steps of Spark's classifier, a tree to a task.

Every task streams the same written blocks (`blocks.py`) once for each level of its tree, so
what it holds is one slice of entries, a count for each entry and the sums of a level. Rows
are drawn with replacement by a hash of their key and the tree's number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame, functions as F

from . import blocks as bl
from .boosting import ALONE_ENTRIES, WHOLE, Settings, Tree, best_split

#: Nodes of a level up to which columns are added up in bundles.
BUNDLED_NODES = 8


def poisson_steps() -> np.ndarray:
    """Hashes from which a row counts once, twice and so on, with mean one."""
    chance = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])
    return np.array([min(int(c * 2.0**64), 2**64 - 1) for c in chance], np.uint64)


@dataclass
class Forest:
    features: list[str]
    edges: list[np.ndarray]
    trees: list[Tree]

    @property
    def featureImportances(self) -> DenseVector:
        """Gains weighted by rows, each tree's as shares, as Spark counts them."""
        total = np.zeros(len(self.features))
        for tree in self.trees:
            own, used = np.zeros(len(self.features)), tree.feature >= 0
            np.add.at(own, tree.feature[used], tree.gain[used])
            total += own / (own.sum() or 1.0)
        return Vectors.dense(total / (total.sum() or 1.0))

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Mean share of the positive class in the leaves that rows reach."""
        bins = bl.binned(x, self.edges).T
        return sum(t.value(bins) for t in self.trees) / len(self.trees)


def prune(tree: Tree) -> None:
    """As in Spark's trees, two leaves of one parent that vote for the same class become one, from below."""
    inner = len(tree.feature)

    def vote(node: int) -> bool:
        hits, weight = tree.sums[node]
        return hits > weight - hits

    for node in reversed(range(inner)):
        below = (2 * node + 1, 2 * node + 2)
        if tree.feature[node] >= 0 and all(b >= inner or tree.feature[b] < 0 for b in below) and vote(below[0]) == vote(below[1]):
            tree.feature[node], tree.cut[node], tree.gain[node] = -1, WHOLE, 0.0
            tree.sums[below[1]], at = 0.0, node
            while at < inner:  # the rows of a node that is not split go left
                tree.sums[2 * at + 1], at = tree.sums[node], 2 * at + 1


def grow(files: Sequence[str], sizes: Sequence[int], entries: int, number: int, depth: int, columns: int,
         bootstrap: bool, seed: int) -> Tree:
    """One tree over all rows; its leaves hold the share of the positive class."""
    k, inner = len(sizes), (1 << depth) - 1
    s = Settings(ridge=0.0, least=0.5)
    draw = np.random.default_rng([seed, number])
    tree = Tree(tuple(range(k)), np.full(inner, -1), np.full(inner, WHOLE), np.zeros(inner), np.zeros(inner + 1), np.zeros((2 * inner + 1, 2)))
    kept = list(bl.slices(files, k)) if entries <= ALONE_ENTRIES else None
    steps, times = poisson_steps(), []

    def rows() -> Iterator:
        return enumerate(bl.slices(files, k) if kept is None else kept)

    for level in range(depth):
        nodes = 1 << level
        groups = bl.bundles(range(k), sizes) if nodes <= BUNDLED_NODES else [[j] for j in range(k)]
        held = [np.zeros((2, nodes * int(np.prod([sizes[j] for j in g])))) for g in groups]
        for i, (bins, y, _, n, ids) in rows():
            if level == 0:
                drawn = np.searchsorted(steps, bl.mixed(ids, seed * 1_000_003 + number), side="right") if bootstrap else np.ones(len(ids), int)
                times.append(np.add.reduceat(drawn, np.cumsum(n) - n, dtype=np.int32))
            w, hit = times[i].astype(float), y == 1
            node = tree.place(bins, level).astype(np.intp)
            for group, sums in zip(groups, held):
                cells = sums.shape[1]
                cell = node * (cells // nodes) + bl.bundled(bins, group, sizes)
                sums[0] += np.bincount(cell[hit], w[hit], cells)
                sums[1] += np.bincount(cell, w, cells)
        found = np.zeros((2, nodes, k, bl.BINS + 1))
        for group, sums in zip(groups, held):
            bl.spread_out(sums, group, sizes, found)
        for at in range(nodes):
            node = nodes - 1 + at
            used = sorted(draw.choice(k, columns, replace=False).tolist())
            g, h = found[:, at, used]
            total = (g[0].sum(), h[0].sum())
            tree.sums[node] = total
            left, right = total, (0.0, 0.0)
            above = level == 0 or tree.feature[(node - 1) // 2] >= 0
            if above and (split := best_split(g, h, s)):
                tree.gain[node], c, tree.cut[node] = split
                tree.feature[node] = used[c]
                left = (g[c, :split[2] + 1].sum(), h[c, :split[2] + 1].sum())
                right = (total[0] - left[0], total[1] - left[1])
            tree.sums[2 * node + 1], tree.sums[2 * node + 2] = left, right
    prune(tree)
    for at in range(inner + 1):
        hits, weight = tree.sums[inner + at]
        tree.leaf[at] = hits / weight if weight else 0.0
    return tree


def fit(df: DataFrame, features: Sequence[str], label: str, trees: int, depth: int, seed: int, bins: int,
        bootstrap: bool = True) -> Forest:
    rows = df.where(F.col(label).isNotNull())
    number, k, spark = rows.count(), len(features), df.sparkSession
    if not number:
        raise ValueError("a forest needs rows")
    edges = bl.bin_edges(rows, features, bins, bl.thresholds)
    sizes = [min(len(e) + 2, bl.BINS + 1) for e in edges]
    files = bl.written_blocks(rows, number, features, edges, label, F.lit(1.0), df.columns, apart=True)
    entries = spark.read.parquet(*files).agg(F.sum(F.length("y") / 8)).head()[0]
    columns = k if trees == 1 else math.ceil(math.sqrt(k))
    grown = spark.sparkContext.parallelize(range(trees), trees).map(
        lambda t: grow(files, sizes, entries, t, depth, columns, bootstrap, seed)).collect()
    return Forest(list(features), edges, grown)
