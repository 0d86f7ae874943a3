"""Nearest-neighbour mutual information against a plain loop over all rows."""

import random
from math import log

import pytest
from pyspark.sql import functions as F

from asphalta.operators import neighbours


def psi(n):
    return sum(1 / i for i in range(1, n)) - 0.5772156649015329


def plain(rows, k=3):
    rows = [(x, y) for x, y in rows if x is not None and y is not None]
    size = {y: sum(b == y for _, b in rows) for _, y in rows}
    rows = [(x, y) for x, y in rows if size[y] >= 2]
    total = 0.0
    for i, (x, y) in enumerate(rows):
        kk = min(k, size[y] - 1)
        near = sorted((abs(a - x), a) for j, (a, b) in enumerate(rows) if b == y and j != i)
        d, u = near[kk - 1]
        if d == 0:
            kk = sum(a == x and b == y for a, b in rows) - 1
            m = sum(a == x for a, _ in rows) - 1
        else:
            low, high = (u, x + d) if u < x else (x - d, u)
            m = sum(low < a < high for a, _ in rows)
        total += psi(kk) - psi(size[y]) - psi(m)
    return max(0.0, psi(len(rows)) + total / len(rows))


def frame(spark, columns, ys):
    names = list(columns)
    return spark.createDataFrame(list(zip(*columns.values(), ys)), ", ".join(f"{n} double" for n in names) + ", y int").repartition(3), names


def test_equal_to_all_pairs(spark):
    draw = random.Random(2)
    ys = [int(draw.random() < 0.3) for _ in range(140)] + [2, 2, 3, None]
    n = len(ys)
    columns = {
        "signal": [float(3 * (y or 0)) + draw.gauss(0, 1) for y in ys], "noise": [draw.random() for _ in ys],
        "few": [float(draw.randrange(3) + (y or 0)) for y in ys], "mixed": [0.0 if draw.random() < 0.6 else draw.random() for _ in ys],
        "grid": [draw.randrange(200) / 4 for _ in ys], "same": [1.5] * n, "holes": [None if draw.random() < 0.3 else draw.random() for _ in ys]}
    df, names = frame(spark, columns, ys)
    for k in (1, 3, 5):
        got = {r["variable"]: r["mutual_info"] for r in neighbours.mutual_information(df, names, "y", k).collect()}
        for name in names:
            assert got[name] == pytest.approx(plain(list(zip(columns[name], ys)), k), abs=1e-9), (name, k)
    assert got["signal"] > 0.3 > got["noise"]


def test_halo_reaches_over_empty_and_small_buckets(spark):
    rows = [("a", float(v), 1, v % 7) for v in range(40)]
    df = spark.createDataFrame(rows, "g string, value double, n long, b int")
    got = neighbours.with_neighbours(df.select("g", "value", "n"), ["g"], "value", F.floor(F.col("value") / 2), 3).collect()
    for r in got:
        assert [p["v"] for p in r["earlier"]] == [float(v) for v in range(max(0, int(r["value"]) - 3), int(r["value"]))]
        assert [p["v"] for p in r["later"]] == [float(v) for v in range(int(r["value"]) + 1, min(40, int(r["value"]) + 4))]


def test_digamma(spark):
    row = spark.range(1, 2).select(*[neighbours.psi(F.lit(float(n))).alias(f"p{n}") for n in (1, 2, 7, 1000)]).head()
    assert [row[0], row[1], row[2], row[3]] == pytest.approx([psi(1), psi(2), psi(7), psi(1000)], abs=1e-10)
    assert abs(row[3] - log(1000)) < 1e-3
