"""Order-dependent work that never puts an unbounded group into one task.

Running totals, ranks and exact quantiles start from counts per distinct value, so
a value holding a third of all rows is one row by the time anything is sorted.
The work has two levels at every size: values fall into range buckets (bounds come
from one `percentile_approx` pass, two for each shuffle partition), each bucket is
accumulated on its own, and bucket totals - at most one row per bucket and group -
give the offsets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

CHUNK = 32


def bucket_count(df: DataFrame) -> int:
    """Buckets follow the cluster: twice the shuffle partitions, which follow the data."""
    return max(16, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def value_bounds(df: DataFrame, columns: Sequence[str], buckets: int | None = None) -> dict[str, list]:
    """Approximate quantiles of each column; they steer balance, never results."""
    buckets = buckets or bucket_count(df)
    fractions = [i / buckets for i in range(1, buckets)]
    row = df.agg(*[
        F.percentile_approx(c, fractions, max(1000, 20 * buckets)).alias(f"b{i}")
        for i, c in enumerate(columns)]).head()
    return {c: sorted(set(row[i] or [])) for i, c in enumerate(columns)}


def _chunks(bounds: Sequence) -> tuple[list, list[list]]:
    """Bounds as first entries and blocks: a lookup scans two short arrays."""
    values = [float(b) for b in bounds]
    blocks = [values[i:i + CHUNK] for i in range(0, len(values), CHUNK)] or [[]]
    return [b[0] for b in blocks if b], blocks


def _array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<double>")


def _below(values: Column, col: Column) -> Column:
    return F.size(F.filter(values, lambda b: b < col))


def bucket_of(col: Column, bounds: Sequence) -> Column:
    """How many bounds lie below the value (0 for NULL)."""
    heads, blocks = _chunks(bounds)
    if len(blocks) == 1:
        return _below(_array(blocks[0]), col.cast("double"))
    block = F.greatest(_below(_array(heads), col.cast("double")), F.lit(1))
    inside = F.element_at(F.array(*[_array(b) for b in blocks]), block)
    return (block - 1) * CHUNK + _below(inside, col.cast("double"))


def bucket_in(variable: Column, value: Column, bounds: Mapping[str, Sequence]) -> Column:
    """Bucket of a value under the bounds of the variable it belongs to.

    The bounds are constant maps, which keeps the generated code small however
    many variables there are.
    """
    split = {c: _chunks(b) for c, b in bounds.items()}
    heads = F.create_map(*[x for c, (h, _) in split.items() for x in (F.lit(c), _array(h))])
    blocks = F.create_map(*[x for c, (_, bs) in split.items()
                            for x in (F.lit(c), F.array(*[_array(b) for b in bs]))])
    block = F.greatest(_below(F.element_at(heads, variable), value), F.lit(1))
    inside = F.element_at(F.element_at(blocks, variable), block)
    return (block - 1) * CHUNK + _below(inside, value)


class Balance:
    """How to spread ordered work over tasks: by value bounds, or not at all.

    Only balance depends on it; results are the same either way. Without bounds each
    group is one window, which a caller asks for that knows its groups to be small.
    """

    def __init__(self, bounds: Mapping[str, Sequence] | None):
        self.bounds = bounds

    @classmethod
    def of(cls, df: DataFrame, columns: Sequence[str]) -> Balance:
        """Bounds from one pass over the columns."""
        return cls(value_bounds(df, columns))

    def bucket(self, name: str, value: Column) -> Column | None:
        return None if self.bounds is None else bucket_of(value, self.bounds[name])

    def bucket_in(self, variable: Column, value: Column) -> Column | None:
        return None if self.bounds is None else bucket_in(variable, value, self.bounds)


def running_totals(
    counts: DataFrame, groups: Sequence[str], value: str, sums: Sequence[str],
    bucket: Column | None, descending: bool = False,
) -> DataFrame:
    """Add `<s>_before` and `<s>_total` for each column to sum.

    `counts` has one row per (groups, value); `<s>_before` is the sum over the
    rows of the group that come strictly earlier.  Without a bucket each group is
    one window partition, which the caller knows to be small.
    """
    groups = list(groups)
    order = F.col(value).desc() if descending else F.col(value).asc()
    whole = Window.partitionBy(*groups)
    if bucket is None:
        earlier = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return counts.select(
            "*", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{s}_before") for s in sums],
            *[F.sum(s).over(whole).alias(f"{s}_total") for s in sums])
    rows = counts.withColumn("_bucket", -bucket if descending else bucket)
    per_bucket = rows.groupBy(*groups, "_bucket").agg(*[F.sum(s).alias(s) for s in sums])
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *groups, "_bucket",
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(s).over(whole).alias(f"{s}_total") for s in sums])
    inside = (Window.partitionBy(*groups, "_bucket").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, -1))
    local = rows.select("*", *[
        F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_in_{s}") for s in sums])
    joined = local.join(offsets, [*groups, "_bucket"])
    return joined.select(
        *counts.columns,
        *[(F.col(f"_off_{s}") + F.col(f"_in_{s}")).alias(f"{s}_before") for s in sums],
        *[f"{s}_total" for s in sums])


def ranked_counts(df: DataFrame, groups: Sequence[str], value: str,
                  balance: Balance | None = None) -> DataFrame:
    """Distinct values with count `n`, `n_before` and `n_total`."""
    kept = df.where(F.col(value).isNotNull())
    balance = balance or Balance.of(kept, [value])
    counts = kept.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counts, groups, value, ["n"], balance.bucket(value, F.col(value)))


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str,
                    probs: Mapping[str, float], balance: Balance | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group."""
    ranked = ranked_counts(df, groups, value, balance)
    aggs = []
    for name, p in probs.items():
        position = (F.col("n_total") - 1) * F.lit(float(p))
        low, high = F.floor(position), F.ceil(position)

        def at(index: Column) -> Column:
            hit = (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n"))
            return F.max(F.when(hit, F.col(value)))

        aggs += [at(low).alias(f"_lo_{name}"), at(high).alias(f"_hi_{name}"),
                 F.max(position - low).alias(f"_f_{name}")]
    picked = ranked.groupBy(*groups).agg(*aggs)
    return picked.select(*groups, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
        for n in probs])


def long_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Numeric columns as (variable, value) rows, NULLs left out."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value"))
        for c in columns])).alias("p")
    return df.select(*keep, pairs).select(*keep, "p.*").where(F.col("value").isNotNull())


def ranked_long(df: DataFrame, groups: Sequence[str], columns: Sequence[str],
                balance: Balance | None = None) -> DataFrame:
    """Counts, running counts and totals per (groups, variable, value), one pass for all."""
    balance = balance or Balance.of(df, columns)
    counts = long_values(df, columns, groups).groupBy(*groups, "variable", "value").agg(
        F.count(F.lit(1)).alias("n"))
    return running_totals(counts, [*groups, "variable"], "value", ["n"],
                          balance.bucket_in(F.col("variable"), F.col("value")))


def median_of_ranked() -> Column:
    """Median of the ranked values of a group: mean of the two middle positions."""
    middle = (F.col("n_total") - 1) / F.lit(2.0)

    def at(index: Column) -> Column:
        hit = (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n"))
        return F.max(F.when(hit, F.col("value")))

    return (at(F.floor(middle)) + at(F.ceil(middle))) / 2


def grouped_medians(df: DataFrame, groups: Sequence[str], columns: Mapping[str, str],
                    balance: Balance | None = None) -> DataFrame:
    """Exact medians of several columns per group; `columns` maps column to output name."""
    ranked = ranked_long(df, groups, list(columns), balance)
    per = ranked.groupBy(*groups, "variable").agg(median_of_ranked().alias("_m"))
    return per.groupBy(*groups).agg(*[
        F.max(F.when(F.col("variable") == c, F.col("_m"))).alias(out)
        for c, out in columns.items()])


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Whole-table median of several numeric columns, as driver scalars."""
    rows = ranked_long(df, [], columns).groupBy("variable").agg(
        median_of_ranked().alias("m")).collect()
    found = {r["variable"]: r["m"] for r in rows}
    return {c: found.get(c) for c in columns}


def with_row_ids(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Number rows 1..n in the given order.

    One range shuffle; rows equal on `order` may be split between ranges, so a
    repeated order key cannot overload a task.  The ranged rows are written once,
    which fixes the numbers, and the offsets are one row per range.
    """
    ranged = (
        df.withColumn("_any", F.monotonically_increasing_id())
        .repartitionByRange(*[F.col(c) for c in order], F.col("_any"))
        .sortWithinPartitions(*order, "_any").drop("_any")
        .withColumn("_pos", F.monotonically_increasing_id()))
    stored = materialize(ranged, "row-ids")
    part, index = F.shiftright("_pos", 33), F.col("_pos").bitwiseAND((1 << 33) - 1)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    # One row a range, which is one a shuffle partition.
    numbered = stored.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.select(
        (F.col("_offset") + index + 1).alias(name), *[c for c in df.columns])


def distinct_position(df: DataFrame, value: str, share: float):
    """Value at position floor(share x n) of the sorted distinct values (driver scalar).

    Meant for calendar-like columns: distinct values are counted and ranked on
    the executors, one value comes back.
    """
    days = df.where(F.col(value).isNotNull()).select(value).distinct()
    numbered = days.select(F.col(value), F.unix_date(F.col(value)).alias("_n"), F.lit(1).alias("n"))
    balance = Balance.of(numbered, ["_n"])
    ranked = running_totals(numbered, [], "_n", ["n"], balance.bucket("_n", F.col("_n")))
    wanted = F.floor(F.col("n_total") * F.lit(share))
    row = ranked.where(F.col("n_before") == wanted).select(value).head()
    return row[0] if row else None


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row per key: the first under an explicit order.

    `row_number() = 1` becomes a group limit before the shuffle, so each map task
    sends at most one row per key, however hot the key.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_rn", F.row_number().over(window))
            .where(F.col("_rn") == 1).drop("_rn"))


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence, k: int,
                  rank_name: str = "rang") -> DataFrame:
    """First k rows per group with their position; also limited before the shuffle."""
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(window)).where(F.col(rank_name) <= k)
