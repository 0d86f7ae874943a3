"""Schema shaping, cleaning and filtering."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def clean_headers(df: DataFrame, blanks: str | None = "_", lower: bool = True) -> DataFrame:
    """Strip blanks and the byte-order mark from headers, then lower and join words."""
    def clean(name: str) -> str:
        name = name.replace("﻿", "").strip()
        name = name.lower() if lower else name
        return name if blanks is None else name.replace(" ", blanks)

    return df.toDF(*[clean(c) for c in df.columns])


def resolve_column(columns: Iterable[str], aliases: Sequence[str]) -> str | None:
    """First alias present, whatever its case, accents and punctuation."""
    by_fold = {tx.fold(c): c for c in columns}
    return next((by_fold[tx.fold(a)] for a in aliases if tx.fold(a) in by_fold), None)


def rename_aliases(df: DataFrame, targets: Mapping[str, Sequence[str]]) -> DataFrame:
    """Give each target name to the first of its aliases found in the frame."""
    renames = {}
    for target, aliases in targets.items():
        found = resolve_column(df.columns, aliases)
        if found is not None and found != target:
            renames[found] = target
    return df.withColumnsRenamed(renames)


def require_columns(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Names that are absent, sorted; empty when the frame is usable."""
    return sorted(set(names) - set(df.columns))


def normalise_key(df: DataFrame, name: str, aliases: Sequence[str]) -> DataFrame:
    """Alias to `name`, as trimmed text without a trailing '.0'."""
    named = rename_aliases(df, {name: [name, *aliases]})
    if name not in named.columns:
        return named
    return named.withColumn(name, tx.without_decimal_tail(F.col(name).cast("string")))


def sentinels_to_null(df: DataFrame) -> DataFrame:
    """Known "no value" spellings to NULL in every text and numeric column."""
    def clean(field: T.StructField) -> Column:
        col = quoted(field.name)
        if isinstance(field.dataType, T.StringType):
            return tx.sentinel_to_null(col, "string").alias(field.name)
        if isinstance(field.dataType, NUMERIC):
            return tx.sentinel_to_null(col, field.dataType.simpleString()).alias(field.name)
        return col

    return df.select([clean(f) for f in df.schema])


def trim_texts(df: DataFrame) -> DataFrame:
    return df.select([
        F.trim(quoted(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType)
        else quoted(f.name) for f in df.schema])


def drop_all_null_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def in_department(col: Column, code: str) -> Column:
    """Department code with or without the leading zero."""
    return F.trim(col).isin(code, code.zfill(3))


def any_of_pairs(kind: Column, code: Column, allowed: Mapping[str, Sequence[str]]) -> Column:
    """OR over (object type, list of codes)."""
    expr = F.lit(False)
    for name, codes in allowed.items():
        expr = expr | ((kind == name) & code.isin(*codes))
    return expr


def paris_codes() -> dict[str, list[str]]:
    """Codes of the city at each geographic level; districts follow a rule."""
    return {"DEP": ["75"], "ARR": ["751"], "COM": ["75056"],
            "ARM": [f"751{i:02d}" for i in range(1, 21)]}


def null_shares(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, float]:
    """Share of NULLs per column: one aggregate, one row to the driver."""
    names = list(columns or df.columns)
    row = df.agg(*[F.avg(quoted(c).isNull().cast("int")).alias(f"s{i}")
                   for i, c in enumerate(names)]).head()
    return {c: row[i] for i, c in enumerate(names)}


def drop_near_empty(df: DataFrame, limit_pct: float = 99.0) -> DataFrame:
    """Drop columns whose NULL percentage is strictly above the limit."""
    shares = null_shares(df)
    return df.drop(*[c for c, s in shares.items() if s is not None and s * 100 > limit_pct])


def informative_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at least two distinct non-null values: min differs from max."""
    present = [c for c in columns if c in df.columns]
    row = df.agg(*[(F.min(quoted(c)) < F.max(quoted(c))).alias(f"v{i}")
                   for i, c in enumerate(present)]).head()
    return [c for i, c in enumerate(present) if row[i]]


def negatives_to_null(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) >= 0, F.col(column)))


def type_by_prefix(df: DataFrame, prefix: str, kind: str, skip: Sequence[str] = ()) -> DataFrame:
    """Lenient cast of every column whose name starts with the prefix."""
    names = [c for c in df.columns if c.startswith(prefix) and c not in skip]
    return df.withColumns({c: tx.lenient(quoted(c), kind) for c in names})


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exact columns, order and types; absent columns become NULL."""
    have = set(df.columns)
    return df.select([
        (quoted(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema])


def keep_selected(df: DataFrame, chosen: Mapping[str, Sequence]) -> DataFrame:
    """Multi-select filter; an empty list means no filter on that column."""
    for name, values in chosen.items():
        if values:
            df = df.where(F.col(name).isin(*values))
    return df


def move_after_first(df: DataFrame, name: str) -> DataFrame:
    rest = [c for c in df.columns if c != name]
    return df.select(*[quoted(c) for c in [*rest[:1], name, *rest[1:]]])


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name, absent columns as NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def narrow_longs(df: DataFrame) -> DataFrame:
    """64-bit whole numbers to 32-bit for export; out-of-range values become NULL."""
    return df.select([
        quoted(f.name).try_cast("int").alias(f.name) if isinstance(f.dataType, T.LongType)
        else quoted(f.name) for f in df.schema])


def nested_to_json(df: DataFrame) -> DataFrame:
    """Struct, map and array columns as JSON text, so that rows can be compared."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select([
        F.to_json(quoted(f.name)).alias(f.name) if isinstance(f.dataType, nested)
        else quoted(f.name) for f in df.schema])


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Struct fields as top-level columns named by their path."""
    def walk(prefix: list[str], fields: T.StructType) -> list[Column]:
        out = []
        for f in fields:
            path = [*prefix, f.name]
            if isinstance(f.dataType, T.StructType):
                out += walk(path, f.dataType)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)))
        return out

    return df.select(walk([], df.schema))


DATE_SHAPES = ("an+mois+jour", "aaaammjj", "t_1h", "t_debut", "time_period", "annee")


def unified_date(df: DataFrame, out: str = "date") -> DataFrame:
    """Add a timestamp column from whichever temporal columns the frame has.

    A frame that already has the column, or has no temporal column, is returned
    unchanged.  Columns fully absorbed by the new one are dropped.
    """
    from ..functions import dates as dt

    cols = set(df.columns)
    if out in cols:
        return df
    if {"an", "mois", "jour"} <= cols:
        day = dt.date_from_parts(F.col("an"), F.col("mois"), F.col("jour"))
        clock = F.col("hrmn") if "hrmn" in cols else F.lit("0000")
        stamp, used = dt.timestamp_from(day, clock), ["an", "mois", "jour", "hrmn"]
    elif "aaaammjj" in cols:
        stamp, used = dt.compact_date(F.col("aaaammjj")).cast("timestamp_ntz"), ["aaaammjj"]
    elif "t_1h" in cols or "t_debut" in cols:
        name = "t_1h" if "t_1h" in cols else "t_debut"
        stamp, used = F.col(name).try_cast("timestamp_ntz"), []
    else:
        name = next((c for c in ("time_period", "année", "annee") if c in cols), None)
        if name is None:
            return df
        day = F.concat(F.col(name).cast("string"), F.lit("-01-01"))
        stamp, used = day.try_cast("timestamp_ntz"), []
    dated = df.withColumn(out, dt.stamp_text(stamp)).drop(*used)
    return move_after_first(dated, out)
