"""Joins: semi, decode, lookup, match rates.

No side is forced to broadcast: sizes decide (`autoBroadcastJoinThreshold`, and
AQE from measured sizes), and a hot key in a shuffle join is split by AQE.  Right
sides are reduced to one row per key first, so a left join keeps the left grain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import first_per_key


def semi(df: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key exists in the parent."""
    return df.join(parent.select(*keys), list(keys), "left_semi")


def left_lookup(df: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str],
                order: Sequence | None = None) -> DataFrame:
    """Left join to the first right row per key; the left grain is kept."""
    slim = right.select(*keys, *values)
    single = first_per_key(slim, keys, order or [F.col(v) for v in values])
    return df.join(single, list(keys), "left")


def smallest_per_key(right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Key to its smallest value; NULL keys and values play no part."""
    kept = right.na.drop(subset=[*keys, value])
    return kept.groupBy(*keys).agg(F.min(value).alias(value))


SCATTER = 997


def left_scattered(df: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which rows with a NULL key, which find nothing, do not meet in one task."""
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    spread = F.when(missing, F.pmod(F.xxhash64(*df.columns), F.lit(SCATTER))).otherwise(0).cast("int")
    return df.withColumn("_spread", spread).join(
        right.withColumn("_spread", F.lit(0)), [*keys, "_spread"], "left").drop("_spread")


def fill_from(df: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Fill NULLs of `value` by an equality lookup."""
    single = smallest_per_key(right, keys, value).withColumnRenamed(value, "_found")
    joined = left_scattered(df, single, keys)
    return joined.withColumn(value, F.coalesce(F.col(value), F.col("_found"))).drop("_found")


def decode(df: DataFrame, meta: DataFrame, variable: str, code_col: str, label_col: str,
           order: str) -> DataFrame:
    """Code to label by a (variable, code, label) table; the last entry wins."""
    table = first_per_key(
        meta.where(F.col("cod_var") == variable), ["cod_mod"], [F.col(order).desc()])
    table = table.select(F.col("cod_mod").alias(code_col), F.col("lib_mod").alias(label_col))
    return df.join(table, code_col, "left")


def left_with_marker(left: DataFrame, right: DataFrame, keys: Sequence[str],
                     shared: Sequence[str] = (), suffix: str = "_autres",
                     order: Sequence | None = None) -> DataFrame:
    """Left join with a `matched` flag.

    Descriptive columns both sides carry are dropped from the right; other name
    clashes get the suffix.
    """
    right = right.drop(*[c for c in shared if c not in keys])
    clashes = {c: c + suffix for c in right.columns if c in left.columns and c not in keys}
    right = right.withColumnsRenamed(clashes)
    values = [c for c in right.columns if c not in keys]
    single = first_per_key(right, keys, order or [F.col(v) for v in values])
    joined = left.join(single.withColumn("_hit", F.lit(True)), list(keys), "left")
    return joined.withColumn("matched", F.col("_hit").isNotNull()).drop("_hit")


def match_summary(joined: DataFrame) -> DataFrame:
    """Rows, matched rows and match percentage of a marked join."""
    n = F.count(F.lit(1))
    hits = F.count_if(F.col("matched"))
    return joined.agg(
        n.alias("lignes_avant"), hits.alias("lignes_matchees"),
        F.coalesce(F.try_divide(hits * 100.0, n), F.lit(0.0)).alias("taux_match"))


def key_match_rate(a: DataFrame, b: DataFrame, key_a: Column, key_b: Column,
                   source_a: str, source_b: str, key: str) -> DataFrame:
    """Share of rows whose key exists on the other side, both ways, NULLs left out.

    Both sides are reduced to (key, rows) before they meet: one full join of
    distinct keys answers both directions.
    """
    def counted(df: DataFrame, col: Column, n: str) -> DataFrame:
        return (df.select(col.cast("string").alias("_k")).where(F.col("_k").isNotNull())
                .groupBy("_k").agg(F.count(F.lit(1)).alias(n)))

    both = counted(a, key_a, "_a").join(counted(b, key_b, "_b"), "_k", "full")

    def rate(mine: str, other: str) -> Column:
        hit = F.sum(F.when(F.col(other).isNotNull(), F.col(mine)).otherwise(0))
        return F.coalesce(F.try_divide(hit * 100.0, F.sum(mine)), F.lit(0.0))

    return both.agg(rate("_a", "_b").alias("taux_match_a_vers_b"),
                    rate("_b", "_a").alias("taux_match_b_vers_a")).select(
        F.lit(source_a).alias("source_a"), F.lit(source_b).alias("source_b"),
        F.lit(key).alias("cle"), "taux_match_a_vers_b", "taux_match_b_vers_a")


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys present on both sides."""
    return a.select(key).intersect(b.select(key))
