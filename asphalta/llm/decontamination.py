"""Benchmark decontamination by a broadcast hash set of word windows, all in DataFrame functions.

A benchmark item's windows are its runs of `size` consecutive words; an item of fewer is
one window. Every g-gram (g: half a window) of a window is hashed into the set with the
window and the g-gram's offset in it. A document's words are scanned in steps of
window - g + 1 words: exactly one g-gram at such a step lies inside any one occurrence
of a window, so each occurrence is met once although most positions are never hashed.
A g-gram in the set is verified by comparing the words of the whole window.

The set is counted before it is broadcast; beyond `most` entries it is dealt into shards,
each broadcast by itself and scanned against all documents. Only hits and one row per
document are shuffled. Which items a document holds is looked up once for each different
set of windows, so groups of copies share that work.

Defined cases: a null or empty text has no words; items without words have no windows;
items of one id are one item, and items without an id count as one, listed as an empty
string; repeated rows each give a row; an empty benchmark leaves every document clean; an
empty table gives an empty result; extra columns are ignored by `contamination` and pass
through `decontaminate`, where names that start with two underscores are taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import lower_ascii, query, row_key, saved, table

#: What lies between lower-cased words, and the words of a text as written.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
AS_WRITTEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Entries of the set that are broadcast at once, about 150 bytes each.
MOST = 500_000
#: Tasks that one set of windows is dealt to.
SALTS = 32


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def gram(length: int) -> int:
    """Words hashed together when windows of this length are looked for."""
    return (length + 1) // 2


def gram_key(length: Column, words: Column, start: Column, grams: Column) -> Column:
    return F.xxhash64(length, F.slice(words, start + 1, grams))


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(item, window, words) of every different window of every item; window is a digest of its words."""
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("all"))
    length = F.least(F.size("all"), F.lit(size))
    starts = F.explode(F.sequence(F.lit(0), F.size("all") - length)).alias("start")
    cut = items.where("size(all) > 0").select("item", "all", length.alias("length"), starts)
    words = cut.select("item", F.slice("all", F.col("start") + 1, F.col("length")).alias("words"))
    return words.select("item", F.md5(F.array_join("words", " ").cast("binary")).alias("window"), "words").distinct()


def hash_set(windows: DataFrame) -> DataFrame:
    """(key, window, words, offset) of every g-gram of every window."""
    once = windows.select("window", "words", F.size("words").alias("length")).distinct()
    grams = F.floor((F.col("length") + 1) / 2).cast("int")
    spread = once.select("*", grams.alias("grams"), F.explode(F.sequence(F.lit(0), F.col("length") - grams)).alias("offset"))
    return spread.select(
        gram_key(F.col("length"), F.col("words"), F.col("offset"), F.col("grams")).alias("key"), "window", "words", "offset")


def probes(words: Column, lengths: list[int]) -> Column:
    """(length, at, key) of the g-grams looked up in a document, after one of length 0 for the document itself."""
    kind = "array<struct<length: int, at: int, key: bigint>>"
    parts = [F.array(F.struct(F.lit(0).alias("length"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("key")))]

    def looked_up(length: int, g: int) -> Column:
        places = F.sequence(F.lit(0), F.size(words) - g, F.lit(length - g + 1))
        return F.transform(places, lambda at: F.struct(
            F.lit(length).alias("length"), at.alias("at"), gram_key(F.lit(length), words, at, F.lit(g)).alias("key")))

    for length in lengths:
        parts.append(F.when(F.size(words) >= length, looked_up(length, gram(length))).otherwise(F.array().cast(kind)))
    return F.concat(*[p.cast(kind) for p in parts])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", size: int = 10,
                  most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(doc, row, copies, n_words, spans, windows) of every different row, and the (item, window) table.

    spans: the (start, end) word ranges hit, merged and in order; windows: the windows that occur.
    """
    windows, _ = saved(benchmark_windows(benchmark, item_col, item_text_col, size), "benchmark-windows")
    entries, _ = saved(hash_set(windows), "benchmark-set")
    total = entries.count()
    lengths = sorted(r.n for r in windows.select(F.size("words").alias("n")).distinct().collect())  # at most `size`
    # The array binds the words, so that no optimiser rule repeats their split for each window.
    bound = F.transform(F.array(words_of(F.col(text_col))), lambda w: F.struct(
        w.alias("words"), probes(w, lengths).alias("probes")))
    split = docs.select(F.col(id_col).alias("doc"), row_key(id_col, text_col).alias("row"), F.inline_outer(bound))
    looked = split.select("doc", "row", "words", F.explode("probes").alias("probe"))
    itself = entries.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("key"), F.lit(None).cast("string").alias("window"),
        F.array().cast("array<string>").alias("words"), F.lit(0).alias("offset"))
    shards = max(1, -(-total // most))
    hits = []
    for shard in range(shards):
        part = entries.where(F.pmod(F.xxhash64("window"), F.lit(shards)) == shard)
        small = (part.union(itself) if shard == 0 else part).select(
            "key", "window", F.col("words").alias("expected"), "offset")
        start = F.col("probe.at") - F.col("offset")
        same = (F.size("expected") == F.col("probe.length")) & (start >= 0) & (
            F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("expected")) == F.col("expected"))
        hits.append(looked.join(F.broadcast(small), (F.col("probe.key") == F.col("key")) & same).select(
            "doc", "row", F.size("words").alias("n_words"), "window", start.alias("start"),
            (start + F.col("probe.length")).alias("end")))
    found = reduce(DataFrame.union, hits)
    hit = F.col("window").isNotNull()
    per_row = found.groupBy("doc", "row").agg(
        F.sum(F.when(hit, 0).otherwise(1)).alias("copies"), F.max("n_words").alias("n_words"),
        F.collect_set(F.when(hit, F.struct("start", "end"))).alias("places"),
        F.sort_array(F.collect_set("window")).alias("windows"))
    return per_row.select(
        "doc", "row", "copies", F.col("n_words").cast("long").alias("n_words"),
        merged(F.array_sort("places")).alias("spans"), "windows"), windows.select("item", "window")


def merged(places: Column) -> Column:
    """Ordered (start, end) ranges with those that touch or overlap made one."""
    kind = "array<struct<start: int, end: int>>"

    def add(done: Column, place: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], place["end"]).alias("end"))
        joins = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= place["start"])
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(
            F.concat(done, F.array(place))).cast(kind)

    return F.aggregate(places, F.array().cast(kind), add)


def item_lists(found: DataFrame, item_windows: DataFrame) -> DataFrame:
    """(set_key, items): the sorted items of every different set of windows."""
    sets = found.where("size(windows) > 0").select(set_key(), "windows").dropDuplicates(["set_key"])
    one = sets.select("set_key", F.explode("windows").alias("window"))
    return one.join(item_windows, "window").groupBy("set_key").agg(F.sort_array(F.collect_set("item")).alias("items"))


def set_key() -> Column:
    return F.md5(F.array_join("windows", ",").cast("binary")).alias("set_key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", size: int = 10, remove: str = "spans",
                  most: int = MOST) -> DataFrame:
    """docs without the hit words (remove="spans") or without the documents that hold any ("documents").

    A hit word goes with what stands between it and the next word.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is 'spans' or 'documents', not {remove!r}")
    found, _ = contamination(docs, benchmark, id_col, text_col, item_col, item_text_col, size, most)
    held = found.where("size(spans) > 0").select(
        F.col("doc").alias("__doc"), F.col("row").alias("__at"), F.col("spans").alias("__spans"))
    keyed = docs.withColumn("__row", row_key(id_col, text_col))
    same = keyed[id_col].eqNullSafe(held["__doc"]) & (keyed["__row"] == held["__at"])
    if remove == "documents":
        return keyed.join(held, same, "left_anti").select(*docs.columns)
    text = F.col(text_col)
    gaps = F.split(text, AS_WRITTEN, -1)
    words = F.regexp_extract_all(text, F.lit(AS_WRITTEN), F.lit(0))
    pieces = F.zip_with(words, F.slice(gaps, F.lit(2), F.size(words)), lambda w, g: F.concat(w, g))
    numbered = F.transform(pieces, lambda p, i: F.struct(p.alias("piece"), i.alias("at")))
    left = F.filter(numbered, lambda p: ~F.exists("__spans", lambda s: (s["start"] <= p["at"]) & (p["at"] < s["end"])))
    cut = F.concat(F.element_at(gaps, 1), F.array_join(F.transform(left, lambda p: p["piece"]), ""))
    joined = keyed.join(held, same, "left")
    return joined.select(*[
        F.when(F.col("__spans").isNull(), text).otherwise(cut).alias(c) if c == text_col else F.col(c)
        for c in docs.columns])


_SQL_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""


@query("op13_benchmark_decontamination", f"""
 WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS words FROM documents),
 items AS (SELECT item_id, {_SQL_WORDS} AS words FROM benchmark),
 windows AS (
  SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS gram FROM (
   SELECT item_id, words, least(len(words), 10) AS n, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS i
   FROM items WHERE len(words) > 0)),
 runs AS (
  SELECT rid, n, i, array_to_string(words[i:i + n - 1], ' ') AS gram FROM (
   SELECT rid, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(words) >= n)),
 hits AS (SELECT rid, r.n, i, gram, item_id FROM runs r JOIN windows w USING (n, gram)),
 covered AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid),
 held AS (
  SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT rid, coalesce(CAST(item_id AS VARCHAR), '') AS item FROM hits) GROUP BY rid)
 SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
 FROM d LEFT JOIN covered USING (rid) LEFT JOIN held USING (rid)""")
def op13_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found, item_windows = contamination(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark").select("item_id", "text"))
    found, _ = saved(found.withColumn("set_key", set_key()), "contamination")
    # Rows without hits need no list; the others' keys are salted, as one set may be that of most of them.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    lists = item_lists(found, item_windows).select(
        "set_key", F.size("items").alias("n_items"), F.array_join("items", ",").alias("listed")).select(
        "set_key", "n_items", F.sha2("listed", 256).alias("items_sha256"), salts)
    salted = found.where("size(windows) > 0").withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    clean = found.where("size(windows) = 0").withColumns(
        {"n_items": F.lit(0), "items_sha256": F.sha2(F.lit(""), 256)})
    whole = clean.unionByName(salted.join(lists, ["set_key", "salt"]).drop("salt"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy")
    return whole.select(
        F.col("doc").alias("doc_id"), "n_words", hit.alias("n_hit"), F.col("n_items").cast("long").alias("n_items"),
        "items_sha256", (F.size("spans") > 0).alias("contaminated"), copies).drop("__copy")
