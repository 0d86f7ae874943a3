"""Line-first quality rules.

Each line is judged on its own (navigation, boilerplate, punctuation); lines that fail
are taken out of the text, and a document that loses more than `max_loss` of its
non-blank characters is rejected. Base rules on the whole text (too short, too
repetitive) reject as well.

Line rules, for lines that are not blank:
- navigation: at least `min_separators` menu separators, one for each four words or
  more; or one of three or more short lines in a row without an end mark, short both in
  words and in characters (wide ones count twice);
- boilerplate: has at most 25 words, more than half of them in phrases of BOILERPLATE; a
  third is enough if two different phrases stand there or one of them is in PLAIN_FURNITURE;
- punctuation: more than `max_symbols` of its non-blank characters are symbols, or at
  least half of its words end with two or more marks in a row;
- stutter: of eight or more words, at least half repeat the word before.

Defined cases: a null text has no words, fails the base rules and its cleaned text is
empty; blank lines are never judged and never lost; repeated rows get equal results;
an empty table gives an empty result; other columns pass through, while input columns
named like a result give way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from unicodedata import east_asian_width

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import query, small_batches, table

BLANKS = " \t\n\x0b\x0c\r"
WORD = re.compile("[^ \t-\r]+")
SYMBOLS = "#*$%&|<>"
#: Fixed phrases of page furniture, lower case.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "click here", "cookie policy", "enable javascript", "follow us on",
    "licensed under", "lorem ipsum", "log in", "newsletter", "privacy policy", "read more", "released under",
    "share this", "sign in", "sign up", "skip to content", "subscribe to", "terms of service", "terms of use",
    "use of cookies")
#: Those of them that ordinary prose hardly uses.
PLAIN_FURNITURE = frozenset((
    "all rights reserved", "accept cookies", "click here", "cookie policy", "enable javascript", "follow us on", "lorem ipsum",
    "privacy policy", "skip to content", "terms of service", "terms of use", "use of cookies"))
END_MARKS = ".!?;:…。！？»”\"')],，、；：،؛؟।॥—–-"
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[str], window: int = 8) -> int:
    """Words that lie in a window of `window` words standing twice or more in the text.

    Windows are numbered exactly: equal pairs of equal halves get equal numbers, from
    words to windows of 2, 4 and 8.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    span = 1
    while span < window:
        pairs = ids[:-span] * (int(ids.max()) + 1) + ids[span:]
        ids = np.unique(pairs, return_inverse=True)[1]
        span *= 2
    twice = np.bincount(ids)[ids] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += twice
    edges[window:window + n] -= twice
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base_signals(text: str, lines: list[str]) -> tuple[int, ...]:
    """The SIGNALS of a text."""
    words = WORD.findall(text)
    symbols = sum(map(text.count, SYMBOLS))
    filled = [line for line in lines if line.strip(BLANKS)]
    return (len(words), sum(map(len, words)), symbols, len(filled) - len(set(filled)), repeated_words(words))


class LineRules:
    """The rules for lines, with their limits."""

    def __init__(self, min_separators: int = 3, max_symbols: float = 0.12, short: int = 3,
                 short_width: int = 24):
        self.min_separators, self.max_symbols, self.short, self.short_width = min_separators, max_symbols, short, short_width
        self.separators = re.compile(r"[|»›•·]")
        self.symbols = re.compile(r"[#*$%&|<>{}~^=_\\+@]")
        self.marked = re.compile(r"[^\w\s]{2,}(?=\s|$)")
        phrases = "|".join(re.escape(p).replace(r"\ ", r"\s+") for p in BOILERPLATE)
        self.furniture = re.compile(rf"(?<!\w)(?:{phrases})(?!\w)")

    def fails(self, line: str) -> str | None:
        """The rule that a line fails, if any."""
        parts = line.split()
        words = len(parts)
        menu = len(self.separators.findall(line))
        if menu >= self.min_separators and 4 * menu >= words:
            return "navigation"
        if words <= 25 and self.is_furniture(line.lower(), words):
            return "boilerplate"
        solid = sum(map(len, parts))
        if len(self.symbols.findall(line)) > self.max_symbols * solid:
            return "punctuation"
        if words >= 4 and 2 * len(self.marked.findall(line)) >= words:
            return "punctuation"
        if words >= 8 and 2 * sum(map(str.__eq__, parts, parts[1:])) >= words:
            return "stutter"
        return None

    def is_furniture(self, line: str, words: int) -> bool:
        """Whether phrases of page furniture make up enough of a lower-case line."""
        found = [" ".join(p.split()) for p in self.furniture.findall(line)]
        held = sum(p.count(" ") + 1 for p in found)
        sure = len(set(found)) > 1 or not PLAIN_FURNITURE.isdisjoint(found)
        return 2 * held > words or sure and 3 * held >= words

    def is_bare(self, line: str) -> bool:
        """Whether a line is short and ends without a mark, as menu entries do."""
        parts = line.split()
        if not parts or len(parts) > self.short or parts[-1][-1] in END_MARKS:
            return False
        inner = " ".join(parts)
        return len(inner) <= self.short_width and sum(
            1 + (east_asian_width(c) in "WF") for c in inner) <= self.short_width

    def judge(self, lines: list[str]) -> list[str | None]:
        verdicts = [self.fails(line) if line.strip() else None for line in lines]
        bare = [self.is_bare(line) for line in lines]
        at = 0
        while at < len(lines):
            end = at
            while end < len(lines) and bare[end]:
                end += 1
            if end - at >= 3:
                verdicts[at:end] = ["navigation"] * (end - at)
            at = max(end, at + 1)
        return verdicts


def clean(text: str, rules: LineRules) -> tuple[str, float, tuple[int, ...]]:
    """The text without failing lines, the share of non-blank characters lost, the base signals."""
    lines = text.split("\n")
    verdicts = rules.judge(lines)
    signals = base_signals(text, lines)
    solid = [sum(map(len, line.split())) for line in lines]
    lost = sum(n for n, v in zip(solid, verdicts) if v)
    return "\n".join(x for x, v in zip(lines, verdicts) if not v), lost / max(1, sum(solid)), signals


def quality_rules(docs: DataFrame, text_col: str = "text", max_loss: float = 0.5, min_words: int = 20,
                  max_repeat: int = 30, rules: LineRules | None = None) -> DataFrame:
    """docs with the base signals, cleaned_text, lost_share, base_failed and kept."""
    rules = rules or LineRules()
    results = T.StructType(
        [T.StructField(n, T.LongType()) for n in SIGNALS]
        + [T.StructField("cleaned_text", T.StringType()), T.StructField("lost_share", T.DoubleType())])
    names = set(results.names) | {"base_failed", "kept"}
    through = docs.select(*[c for c in docs.columns if c not in names])
    place = through.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [clean(text or "", rules) for text in batch.column(place).to_pylist()]
            signals = list(zip(*(x[2] for x in found))) or [()] * len(SIGNALS)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(s, pa.int64()) for s in signals),
                 pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=[*batch.schema.names, *results.names])

    judged = through.mapInArrow(judge, T.StructType([*through.schema.fields, *results.fields]))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("lost_share") <= max_loss))


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules(table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *SIGNALS, "base_failed", "kept", "lost_share")
