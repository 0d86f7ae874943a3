"""Line dedup with levelled sorted runs of line hashes.

A run is a written table of (key hash, n_docs) sorted by hash. Each batch of documents
merge-anti-joins the settled run (keys already known to be frequent need no more
counting), counts the rest and adds them as a run of its own at level 0. When a level
holds `fanout` runs they are merged into one run of the next level; keys whose merged
count reaches `min_docs` move to the settled run. Everything is DataFrame functions.

Defined cases: a null or empty text is one empty line; a line that is only white space
has an empty key and is kept when min_chars > 0; repeated rows count as so many
documents and get equal results; null ids are ids like any other; an empty table
gives an empty result; extra columns pass through, but n_lines and n_dropped of the
input give way to the new ones, and names that start with two underscores are taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import small_table
from .common import discard, query, row_key, saved, table

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "key binary, n_docs bigint"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased and nothing else changed."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() is far cheaper than translate(), and equal unless other letters have a lower case.
    other = bare.rlike(r"[\p{javaUpperCase}\p{javaTitleCase}&&[^A-Z]]")
    return F.when(other, F.translate(bare, UPPER, LOWER)).otherwise(F.lower(bare))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int, batches: int) -> DataFrame:
    """One row per document: its id, row hash, batch and the 128-bit key hash of every line in order.

    Lines whose key is shorter than min_chars have a null hash.
    """
    keys = F.transform(text_lines(F.col(text_col)), line_key)
    row = row_key(id_col, text_col)
    return docs.select(
        F.col(id_col).alias("doc"), row.alias("row"), F.pmod(row, F.lit(batches)).cast("int").alias("batch"),
        F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, F.md5(k.cast("binary")))).alias("keys"))


class LineRuns:
    """Levelled sorted runs of line-key document counts."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[str]] = [[]]
        self.settled: list[str] = []

    def _write(self, df: DataFrame, label: str) -> str:
        ordered = df.repartition("key").sortWithinPartitions("key")
        return saved(ordered, label)[1]

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*paths)

    def add(self, keys: DataFrame) -> None:
        """keys: one row per document and distinct key of it."""
        if self.settled:
            keys = keys.join(self._read(self.settled).select("key"), "key", "left_anti")
        run = keys.groupBy("key").agg(F.count("*").alias("n_docs"))
        self.levels[0].append(self._write(run, "line-run"))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merge the runs of a level into one of the next, settling keys that are frequent."""
        if len(self.levels) == level + 1:
            self.levels.append([])
        old, self.levels[level] = self.levels[level], []
        merged, path = saved(
            self._read(old).groupBy("key").agg(F.sum("n_docs").alias("n_docs"))
            .sortWithinPartitions("key"), "line-merge")
        self.settled.append(self._write(merged.where(F.col("n_docs") >= self.min_docs), "line-settled"))
        self.levels[level + 1].append(self._write(merged.where(F.col("n_docs") < self.min_docs), "line-run"))
        discard(self.spark, [*old, path])

    def frequent(self) -> DataFrame:
        """Every key found in at least min_docs documents, as a written table."""
        runs = [p for level in self.levels for p in level]
        parts = [self._read(self.settled).select("key")] if self.settled else []
        if runs:
            parts.append(self._read(runs).groupBy("key").agg(F.sum("n_docs").alias("n_docs"))
                         .where(F.col("n_docs") >= self.min_docs).select("key"))
        found = saved(reduce(DataFrame.union, parts), "line-frequent")[0]
        discard(self.spark, [*runs, *self.settled])
        return found


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1,
                min_docs: int = 10, batches: int = 4, fanout: int = 2, keep_first: bool = False) -> DataFrame:
    """docs without the lines whose key stands in at least min_docs documents.

    keep_first leaves each such key its first line, that of the smallest id. Adds n_lines (before) and n_dropped; the text column holds the lines left, joined
    by a line feed.
    """
    spark = docs.sparkSession
    hashes, _ = saved(line_hashes(docs, id_col, text_col, min_chars, batches), "line-hashes")
    runs = LineRuns(spark, min_docs, fanout)
    for batch in range(batches):
        own = hashes.where(F.col("batch") == batch).select(F.explode(F.array_distinct("keys")).alias("key"))
        runs.add(own.where("key IS NOT NULL").select(F.unhex("key").alias("key")))
    placed = hashes.select("doc", "row", F.posexplode("keys").alias("pos", "key")).where("key IS NOT NULL")
    common = placed.withColumn("key", F.unhex("key")).join(runs.frequent(), "key", "left_semi")
    if keep_first:
        common, _ = saved(common, "frequent-lines")
        firsts = common.groupBy("key").agg(F.min(F.struct("doc", "row", "pos")).alias("at")).select("at.*")
        common = common.join(
            firsts.select(F.col("doc").alias("__doc"), F.col("row").alias("__at"), F.col("pos").alias("__pos")),
            F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("row") == F.col("__at")) & (F.col("pos") == F.col("__pos")),
            "left_anti")
    dropped = (
        common.groupBy(F.col("doc").alias("__doc"), F.col("row").alias("__at")).agg(F.collect_set("pos").alias("__dropped")))
    dropped = small_table(dropped, "dropped-lines", F.size("__dropped"))
    keyed = docs.withColumn("__row", row_key(id_col, text_col))
    joined = keyed.join(
        dropped, keyed[id_col].eqNullSafe(dropped["__doc"]) & (keyed["__row"] == dropped["__at"]), "left")
    lines = text_lines(F.col(text_col))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__dropped"))
    left = F.when(F.col("__dropped").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col("__lines"), i)), "\n"))
    columns = [left.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.withColumn("__lines", lines).select(
        *columns, F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"))


@query("op4_line_dedup", """
 WITH lines AS (
  SELECT doc_id, rid, i, list_extract(ls, i) AS line,
   translate(trim(list_extract(ls, i), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, rid, ls, CAST(unnest(range(1, len(ls) + 1)) AS BIGINT) AS i
   FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
 frequent AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10)
 SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
 FROM lines l LEFT JOIN frequent f ON l.key = f.key GROUP BY rid, doc_id""")
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
