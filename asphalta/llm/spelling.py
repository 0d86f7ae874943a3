"""Spelling variants: words one edit apart, each with the frequent form it is likely to stand for.

Letters are hashed to a few symbols, dealt so that each symbol is about as frequent, which
makes words strings over a small alphabet. Such a string has few neighbours one edit away, so
the full neighbourhood of every different reduced word is generated and joined with the
reduced vocabulary: words one edit apart have reduced words at most one edit apart. What
meets is verified on the words themselves.

Reduced words that more than `crowd` words share are left to the next, larger alphabet,
whose symbols split those of the smaller one: there the neighbourhoods of their words
meet the whole vocabulary again. With the last alphabet every class is taken. So no pair
is lost, and no class of words is crossed with another beyond the crowd.

A word's form is its near word with the largest count, if that is at least `ratio` times
its own. Counts grow by that factor with each step from form to form, so chains are short
and their ends are found by doubling in a number of rounds known from the largest count.

Defined cases: a null or empty text has no words; a null id counts as an empty one where
letters are dropped; ties go to the smaller word by code points; repeated rows count each
time; an empty table gives an empty result; very long texts are split like any other, and
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import lower_ascii, query, saved, sql_crc32, table

#: Numbers of symbols, each a multiple of the one before.
ALPHABETS = (4, 16, 64)
#: Words of one class beyond which they go to the next alphabet.
CROWD = 64
#: The symbols' characters.
SYMBOLS = "".join(chr(48 + i) for i in range(64))
NOT_LETTERS = r"[^a-zÀ-ÿ]+"


def corpus_words(docs: DataFrame, id_col: str, text_col: str, shortest: int, drop_one_in: int | None) -> DataFrame:
    """(word, n) of all words of at least `shortest` code points that occur twice or more.

    drop_one_in: take a code point out of about one word in so many, which plants misspellings
    where a corpus has none of its own; the choice follows a CRC of id and word.
    """
    runs = F.filter(F.split(lower_ascii(F.col(text_col)), NOT_LETTERS, -1), lambda w: F.char_length(w) >= shortest)
    # The outer form keeps the optimiser from repeating the split in a filter of empty lists.
    words = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.explode_outer(runs).alias("run"))
    word = F.col("run")
    if drop_one_in is not None:
        h = F.crc32(F.concat("doc", F.lit(":"), word).cast("binary"))
        words = words.select(word, h.alias("h"), (h % F.char_length(word)).cast("int").alias("at"))
        cut = F.concat(F.substring(word, F.lit(1), F.col("at")), F.substring(word, F.col("at") + 2, F.char_length(word)))
        word = F.when(F.col("h") % drop_one_in == 0, cut).otherwise(word)
    kept = words.select(word.alias("word")).where(F.char_length("word") >= shortest)
    return kept.groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")


def deal(weights: dict[str, int], hands: int) -> dict[str, int]:
    """Each key's hand, the heaviest first to the hand that has least."""
    held, out = [0] * hands, {}
    for key in sorted(weights, key=lambda k: (-weights[k], k)):
        out[key] = held.index(min(held))
        held[out[key]] += weights[key]
    return out


def letter_symbols(weights: dict[str, int], alphabets: Sequence[int]) -> list[dict[str, int]]:
    """For each alphabet the letters' symbols, of about equal weight, each split by those of the next."""
    levels, before = [], {c: 0 for c in weights}
    for had, symbols in zip((1, *alphabets), alphabets):
        split = symbols // had
        now = {}
        for symbol in range(had):
            inside = deal({c: weights[c] for c in weights if before[c] == symbol}, split)
            now |= {c: symbol * split + hand for c, hand in inside.items()}
        levels.append(now)
        before = now
    return levels


def reduced(word: Column, symbols: dict[str, int]) -> Column:
    """The word with each letter replaced by its symbol."""
    return F.translate(word, "".join(symbols), "".join(SYMBOLS[i] for i in symbols.values()))


def neighbourhood(word: Column, symbols: int) -> Column:
    """The word and all strings over the alphabet one edit away from it."""
    size = F.char_length(word)
    letters = F.array(*map(F.lit, SYMBOLS[:symbols]))

    def around(skip: int, last: Column) -> Column:
        """The word with each symbol put before place i, and `skip` symbols left out there."""
        return F.flatten(F.transform(F.sequence(F.lit(1), last), lambda i: F.transform(letters, lambda c: F.concat(
            F.substring(word, F.lit(1), i - 1), c, F.substring(word, i + skip, size)))))

    dropped = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(
        F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, size)))
    return F.concat(F.array(word), dropped, around(1, size), around(0, size + 1))


def near_pairs(vocabulary: DataFrame, alphabets: Sequence[int] = ALPHABETS, crowd: int = CROWD) -> DataFrame:
    """(a, n_a, b, n_b), a before b, of all words of a (word, n) table that are one edit apart."""
    letters = vocabulary.select(F.explode_outer(F.split("word", "")).alias("c")).groupBy("c").agg(F.count("*").alias("k"))
    weights = {r.c: r.k for r in letters.where("c <> ''").collect()}  # at most one row for each code point there is
    levels, asked = [], None
    for level, (symbols, dealt) in enumerate(zip(alphabets, letter_symbols(weights, alphabets))):
        # Classes go by a hash of the reduced word: should two share one, they are one class.
        short = reduced(F.col("word"), dealt)
        words, _ = saved(vocabulary.select("word", "n", short.alias("short"), F.xxhash64(short).alias("class")), "spelling-classes")
        sizes = words.groupBy("class").agg(F.count("*").alias("size"), F.min("short").alias("short"))
        last = level == len(alphabets) - 1
        calm = sizes if last else sizes.where(F.col("size") <= crowd)
        asking = words if asked is None else words.join(asked, "word", "left_semi")
        listed = [w.join(calm.select("class"), "class", "left_semi").groupBy(F.col("class").alias(f"class_{x}")).agg(
            F.collect_list(F.struct("word", "n")).alias(f"words_{x}")) for x, w in (("a", asking), ("b", words))]
        around = F.transform(neighbourhood(F.col("short"), symbols), lambda v: F.xxhash64(v))
        sources = calm if asked is None else calm.join(asking.select("class"), "class", "left_semi")
        if asked is None:  # all classes ask, and each pair of them is met from one side
            around = F.filter(around, lambda v: v >= F.col("class"))
        near = sources.select(F.col("class").alias("class_a"), F.explode_outer(F.array_distinct(around)).alias("class_b"))
        met = near.join(listed[1], "class_b").join(listed[0], "class_a")
        once = F.col("class_a") != F.col("class_b") if asked is None else F.lit(True)
        found = F.flatten(F.transform("words_a", lambda a: F.transform(
            F.filter("words_b", lambda b: (F.levenshtein(a["word"], b["word"], 1) == 1) & (once | (a["word"] < b["word"]))),
            lambda b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))))
        levels.append(met.select(F.explode_outer(found).alias("pair")).where("pair IS NOT NULL").select(
            F.col("pair.a.word").alias("a"), F.col("pair.a.n").alias("n_a"), F.col("pair.b.word").alias("b"), F.col("pair.b.n").alias("n_b")))
        if last:
            break
        asked, _ = saved(words.join(sizes.where(F.col("size") > crowd), "class", "left_semi").select("word"), "spelling-crowded")
        if asked.isEmpty():
            break
    later = [reduce(DataFrame.union, levels[1:]).distinct()] if len(levels) > 1 else []
    return reduce(DataFrame.union, [levels[0], *later])


def roots(forms: DataFrame, ratio: int) -> DataFrame:
    """(word, root) of a (word, form, n) table, by doubling the steps from form to form."""
    current, _ = saved(forms.select("word", F.col("form").alias("root"), "form_n"), "spelling-forms")
    most = current.agg(F.max("form_n")).first()[0] or 0
    steps = math.log(max(most, 2), ratio)  # a chain starts at 1 or more and grows by the ratio
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        onward = current.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        current, _ = saved(current.join(onward, F.col("root") == F.col("via"), "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), "form_n"), "spelling-forms")
    return current.select("word", "root")


def spelling_variants(vocabulary: DataFrame, ratio: int = 10, alphabets: Sequence[int] = ALPHABETS, crowd: int = CROWD) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of a (word, n) table."""
    vocabulary, _ = saved(vocabulary.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    pairs = near_pairs(vocabulary, alphabets, crowd)
    sides = F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))).alias("side")
    best = pairs.select(sides).groupBy("side.word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("side.near_n")).alias("minus"), F.col("side.near").alias("near"))).alias("best"))
    joined = vocabulary.join(best, "word", "left")
    enough = -F.col("best.minus") >= ratio * F.col("n")
    found, _ = saved(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")), "spelling-near")
    ends = roots(found.where("form IS NOT NULL"), ratio)
    return found.join(ends, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


_SQL = f"""
 WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(
   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{7,}}')) AS run FROM documents),
 hashed AS (SELECT run, count(*) AS k, {sql_crc32("doc || ':' || run")} AS h FROM runs GROUP BY doc, run),
 words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
   SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
 dropped AS (
  SELECT DISTINCT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (
   SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
 near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM dropped a JOIN dropped b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM dropped a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM dropped a JOIN words b ON a.rest = b.word),
 best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS best_n, arg_min(other, (-other_n, other)) AS best FROM near GROUP BY word),
 formed AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form,
   CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
 steps AS (
  SELECT word, word AS at, form AS onward FROM formed
  UNION ALL SELECT s.word, f.word, f.form FROM steps s JOIN formed f ON s.onward = f.word)
 SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN steps s ON f.word = s.word AND s.onward IS NULL"""


@query("op12_spelling_variants", _SQL)
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = corpus_words(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text", 7, 31)
    return spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")
