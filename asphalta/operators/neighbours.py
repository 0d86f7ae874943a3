"""Mutual information of a measure with a class by nearest neighbours.

For a row of class c the distance d to its k-th nearest neighbour of that class is found,
and m, the number of all rows nearer than d (the row itself stands for the k-th neighbour);
with N rows in all and N_c of the class

    MI = psi(N) + mean(psi(k) - psi(N_c) - psi(m)), not below zero.

Where k or more others of the class have the very same value, d is zero; then k and m are
the numbers of other rows with that value, of the class and in all, which keeps measures
of few values right. Classes of one row take no part; k is N_c - 1 if that is fewer.

Everything starts from counts of distinct values. They lie in range buckets; a bucket gets
a halo of the k values before and after it in its class, and m comes from running totals
in which the ends of each interval take part as points without rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import Balance, long_values, running_totals


def psi(x: Column) -> Column:
    """Digamma of a number of one or more, by recurrence and its asymptotic series."""
    z = x + F.lit(6.0)
    series = F.log(z) - 1 / (2 * z) - 1 / (12 * z ** 2) + 1 / (120 * z ** 4) - 1 / (252 * z ** 6) + 1 / (240 * z ** 8)
    for i in range(6):
        series = series - F.lit(1.0) / (x + i)
    return series


def with_neighbours(counts: DataFrame, groups: Sequence[str], value: str, bucket: Column, k: int) -> DataFrame:
    """counts, one row per (groups, value), with `earlier` and `later`: the k values before and after, in order."""
    rows = counts.withColumn("_bucket", bucket)
    point = F.struct(F.col(value).alias("v"), F.col("n").alias("n"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy(value)
    own = rows.select(
        "*", F.collect_list(point).over(inside.rowsBetween(-k, -1)).alias("_before"),
        F.collect_list(point).over(inside.rowsBetween(1, k)).alias("_after"),
        F.row_number().over(inside).alias("_up"),
        F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy(F.col(value).desc())).alias("_down"))
    # The first and last k values of a bucket; any k values before it lie in at most k buckets.
    edges = own.groupBy(*groups, "_bucket").agg(
        F.array_sort(F.collect_list(F.when(F.col("_up") <= k, point))).alias("_first"),
        F.array_sort(F.collect_list(F.when(F.col("_down") <= k, point))).alias("_last"))
    across = Window.partitionBy(*groups).orderBy("_bucket")
    halos = edges.select(
        *groups, "_bucket", F.flatten(F.collect_list("_last").over(across.rowsBetween(-k, -1))).alias("_left"),
        F.flatten(F.collect_list("_first").over(across.rowsBetween(1, k))).alias("_right"))
    joined = own.join(halos, [*groups, "_bucket"])
    left, right = F.concat("_left", "_before"), F.concat("_after", "_right")
    return joined.select(
        *counts.columns, F.slice(left, F.greatest(F.size(left) - k, F.lit(0)) + 1, F.lit(k)).alias("earlier"),
        F.slice(right, F.lit(1), F.lit(k)).alias("later"))


def kth_neighbour(value: Column, own: Column, around: Column, k: Column) -> Column:
    """(dist, v) of the k-th nearest other row: own rows share the value, around holds (v, n) of others."""
    near = F.array_sort(F.transform(around, lambda p: F.struct(F.abs(p["v"] - value).alias("dist"), p["v"].alias("v"), p["n"].alias("n"))))
    start = F.struct((own - 1).alias("seen"), F.when(own - 1 >= k, F.struct(F.lit(0.0).alias("dist"), value.alias("v"))).alias("hit"))

    def take(done: Column, p: Column) -> Column:
        seen = done["seen"] + p["n"]
        return F.struct(seen.alias("seen"), F.when(done["hit"].isNull() & (seen >= k), F.struct(
            p["dist"].alias("dist"), p["v"].alias("v"))).otherwise(done["hit"]).alias("hit"))

    return F.aggregate(near, start, take, lambda done: done["hit"])


def mutual_information(df: DataFrame, columns: Sequence[str], target: str, k: int = 3) -> DataFrame:
    """(variable, mutual_info) in nats of each numeric column with a class column; NULLs take no part."""
    long = long_values(df.where(F.col(target).isNotNull()), columns, [target]).withColumnRenamed(target, "class")
    counts = materialize(long.groupBy("variable", "class", "value").agg(F.count(F.lit(1)).alias("n")), "neighbour-counts")
    sizes = counts.groupBy("variable", "class").agg(F.sum("n").alias("of_class")).where("of_class >= 2")
    counts = counts.join(F.broadcast(sizes), ["variable", "class"])  # one row a variable and class
    balance = Balance.of(df, columns)
    bucket = balance.bucket_in(F.col("variable"), F.col("value"))
    near = with_neighbours(counts, ["variable", "class"], "value", bucket, k)
    wanted = F.least(F.lit(k).cast("long"), F.col("of_class") - 1)
    kth = kth_neighbour(F.col("value"), F.col("n"), F.concat("earlier", "later"), wanted)
    found = materialize(near.select(
        "variable", "class", "value", "n", "of_class", wanted.alias("k"), kth.alias("kth")), "neighbours")
    v, u, d = F.col("value"), F.col("kth.v"), F.col("kth.dist")
    low, high = F.when(u < v, u).otherwise(v - d), F.when(u > v, u).otherwise(v + d)
    # Ends of intervals stand in the same order as the values, as points without rows.
    data = counts.groupBy("variable", "value").agg(F.sum("n").alias("n"))
    ends = found.where(d > 0).select("variable", F.explode(F.array(low, high)).alias("value"), F.lit(0).cast("long").alias("n"))
    points = data.union(ends).groupBy("variable", "value").agg(F.sum("n").alias("n"))
    totals = materialize(running_totals(points, ["variable"], "value", ["n"], bucket).select(
        "variable", F.col("value").alias("point"), F.col("n").alias("at"), "n_before", "n_total"), "neighbour-totals")

    def at(name: str, point: Column, rows: DataFrame) -> DataFrame:
        side = totals.select(F.col("variable").alias("_v"), F.col("point").alias("_p"), F.struct("at", "n_before", "n_total").alias(name))
        return rows.join(side, (F.col("variable") == F.col("_v")) & (point == F.col("_p")), "left").drop("_v", "_p")

    met = at("_same", v, at("_high", F.when(d > 0, high), at("_low", F.when(d > 0, low), found)))
    inside = F.col("_high.n_before") - F.col("_low.n_before") - F.col("_low.at")
    own_k = F.when(d > 0, F.col("k")).otherwise(F.col("n") - 1)
    m = F.when(d > 0, inside).otherwise(F.col("_same.at") - 1)
    return met.groupBy("variable").agg(F.greatest(F.lit(0.0), psi(F.max("_same.n_total")) + F.sum(
        F.col("n") * (psi(own_k) - psi(F.col("of_class")) - psi(m))) / F.max("_same.n_total")).alias("mutual_info"))
