"""Dual-tree search against every inner product."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from asphalta.llm import topk
from asphalta.llm.topk import Best, cover_tree, dual_search, top_k


def plain(rows, queries, k):
    def fine(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and fine(v)]
    out = {}
    for q, v in ints:
        if q in queries:
            scores = {}
            for i, w in ints:
                if i != q and len(w) == len(v):
                    s = sum(a * b for a, b in zip(v, w))
                    scores[i] = max(s, scores.get(i, s))
            out[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return {(q, n, i, s) for q, best in out.items() for n, (i, s) in enumerate(best, 1)}


@pytest.mark.parametrize("spread", [0.0, 0.01, 0.3])
def test_rows(spark, spread, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, spread))) for x in centres[i % 5]]) for i in range(300)]
    rows += [(400, None), (401, [1.0, None] + [0.0] * 4), (402, [float("nan")] * 6), (403, [float("inf")] + [0.0] * 5), (None, centres[0]),
             (404, [0.5, 0.25]), (405, [1.0, 2.0]), (406, []), rows[10], rows[7]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit(1))
    got = top_k(frame, frame.where("vec_id % 10 = 0 OR vec_id = 404"), k=7)
    queries = {i for i, _ in rows if i is not None and (i % 10 == 0 or i == 404)}
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert {tuple(r) for r in got.collect()} == plain(single, queries, 7)


def test_fewer_rows_than_k_and_empty(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(frame, frame.where("vec_id = 0")).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert top_k(frame.where("vec_id > 5"), frame.where("vec_id > 5")).collect() == []


def test_trees_cover_and_prune():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 8)) * 2000
    points = np.floor(centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 8)) * 20)
    tree, waiting = cover_tree(points), []
    waiting.append(tree)
    while waiting:
        node = waiting.pop()
        assert np.linalg.norm(points[node.points] - node.centre, axis=1).max() <= node.radius * (1 + 1e-9) + 1e-9
        if node.kids:
            assert sorted(np.concatenate([k.points for k in node.kids])) == sorted(node.points)
            gaps = np.linalg.norm(node.centres[:, None] - node.centres[None], axis=2)
            assert len(node.kids) == 1 or gaps[~np.eye(len(gaps), dtype=bool)].min() > node.radius / 2 * (1 - 1e-9)
        waiting += node.kids
    asks = points[:200]
    best = Best(np.arange(200), 10)
    computed = dual_search(asks, cover_tree(asks), points, tree, [np.array([i]) for i in range(3000)], best)
    assert computed < 0.5 * 200 * 3000
    products = (asks @ points.T).astype(np.int64)
    products[np.arange(200), np.arange(200)] = topk.LOWEST
    want = np.lexsort((np.broadcast_to(np.arange(3000), products.shape), -products), axis=1)[:, :10]
    assert (best.id == want).all()


def levels(node):
    return 1 + max(map(levels, node.kids)) if node.kids else 0


def test_levels_without_single_points():
    rng = np.random.default_rng(6)
    noise = rng.normal(size=(2000, 64))
    points = np.floor(1024 * noise / np.linalg.norm(noise, axis=1)[:, None])
    tree = cover_tree(points)
    waiting = [tree]
    while waiting:
        node = waiting.pop()
        assert len(node.kids) <= topk.FANOUT
        assert len(node.points) >= topk.LEAF // 2
        assert node.kids or len(node.points) <= topk.LEAF
        waiting += node.kids
    assert levels(tree) >= 3


@pytest.mark.parametrize("spread", [1.0, 60.0])
def test_floors_of_another_block(spread):
    """What one block finds lets the next start higher, and nothing at or above the floor is lost."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16)) * 300
    points = np.floor(centres[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 16)) * spread)
    asks, k = points[::40], 5
    own = np.arange(0, 2000, 40)
    halves = [(points[:1000], np.arange(1000)), (points[1000:], np.arange(1000, 2000))]
    work, found, floors = [], [], None
    for data, ids in halves:
        best = Best(own, k, floors)
        work.append(dual_search(asks, cover_tree(asks), data, cover_tree(data), [np.array([i]) for i in ids], best))
        floors = best.limit
        found.append(best)
    alone = dual_search(asks, cover_tree(asks), halves[1][0], cover_tree(halves[1][0]), [np.array([i]) for i in halves[1][1]], Best(own, k))
    assert work[1] <= alone
    scores, ids = (np.concatenate([getattr(b, a) for b in found], axis=1) for a in ("score", "id"))
    products = (asks @ points.T).astype(np.int64)
    products[np.arange(len(own)), own] = topk.LOWEST
    want = np.lexsort((np.broadcast_to(np.arange(2000), products.shape), -products), axis=1)[:, :k]
    assert (np.take_along_axis(ids, np.lexsort((ids, -scores), axis=1)[:, :k], axis=1) == want).all()


def test_vector_that_fills_a_third_and_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rows = [(i, [1.0, 0.5] if i % 3 == 0 else [float(i % 7) / 8, float(i % 5) / 8]) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(frame, frame.where("vec_id % 20 = 0"), k=10)
    assert {tuple(r) for r in got.collect()} == plain(rows, set(range(0, 400, 20)), 10)
