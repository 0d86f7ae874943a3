"""Personal data and the terms that give it away.

Base spans come from four patterns. Every word that shares documents with a protected
value is then judged by how much of its information it carries in this corpus: with n_te
documents that hold both term t and value e, n_t documents with t, n_e with e and n in all,

    disclosure = log(n * n_te / (n_t * n_e)) / log(n / n_e)

is the share of the value's information content that the term reveals: 1 if e stands in
every document that uses t. Terms at or above `generalise` that were seen with the value
in at least `support` documents and as many different contexts (a term with its `window`
neighbours on each side, so that copies of one passage do not count) become spans of kind
term wherever they stand, in documents without the value too; sanitising removes those at
or above `remove` and generalises the others, as it does the base spans. A term has one
disclosure, its highest over all values.

A value of fewer than `support` documents can therefore disclose nothing, and only the
others' terms are counted. Bloom filters of bounded size keep the rest out of the joins.

Defined cases: null and empty texts have no spans; repeated rows get equal spans and count
as documents each; null ids are ids like any other; an empty table gives an empty result;
other columns pass through `sanitise`. Words that overlap a base span are no terms there.
Overlapping spans are replaced as one, by the mark of the first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import small_table
from .bloom import Bloom
from .common import query, row_key, saved, small_batches, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"
USES = "array<struct<term: string, context: bigint, first: int>>"
COUNTS = "array<struct<term: string, n: bigint>>"
TERM_SPANS = "array<struct<start: bigint, end: bigint, disclosure: double>>"
#: Every ASCII character as it stands in a term: letters in lower case, what belongs to no word as a space.
ASCII_TERMS = "".join(c.lower() if c.isalnum() else " " for c in map(chr, range(128)))
#: Different terms that a task counts before it hands the counts on.
HELD_TERMS = 200_000


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards, which finds what the pattern finds without trying every start."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        part = text[done:at]
        start = done + len(part.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        done = at = found.end() if found else at + 1
        if found:
            yield start, found.end()


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    found = []
    if "@" in text:
        found += [("email", *s) for s in emails(text)]
    found += [("ip", *s) for s in ips(text)]
    found += [("card", *s) for s in cards(text)]
    if "+" in text:
        found += [("phone", *s) for s in phones(text)]
    return found


def digest(text: str) -> int:
    """A signed 64-bit hash, equal to Spark's xxhash64 of the text."""
    value = xxhash.xxh64_intdigest(text, 42)
    return value - (1 << 64) if value >> 63 else value


@cache
def word_characters() -> np.ndarray:
    """Whether a code point belongs to words: letters and numbers of any script."""
    return np.array([chr(c).isalnum() for c in range(0x110000)])


class Terms(dict):
    """The term of every word met, and with places() where the words of a text stand."""

    def __init__(self, of: Callable[[str], object] = str.lower):
        self.of = of

    def __missing__(self, word: str):
        if len(self) >= HELD_TERMS:
            self.clear()
        term = self[word] = self.of(word)
        return term

    def places(self, text: str, spans: list[tuple[str, int, int]]) -> tuple[list, np.ndarray, np.ndarray]:
        """Terms, starts and ends of all words that overlap no span."""
        inside = np.zeros(len(text) + 2, np.int8)
        inside[1:-1] = word_characters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        if spans:
            low, high = np.array(sorted((a, b) for _, a, b in spans)).T
            reach = np.r_[0, np.maximum.accumulate(high)]  # how far the spans that begin before the word's end go
            free = reach[np.searchsorted(low, ends, "left")] <= starts
            starts, ends = starts[free], ends[free]
        return [self[text[a:b]] for a, b in zip(starts.tolist(), ends.tolist())], starts, ends


def ascii_terms(text: str) -> list[str]:
    """The terms of all words of an ASCII text, the same as from places without spans."""
    return text.translate(ASCII_TERMS).split()


class LikelyTerms:
    """Which terms of ASCII texts may be among a filter's keys, asked once for each new term."""

    def __init__(self, likely: Bloom):
        self.likely, self.known = likely, {}

    def texts_with(self, texts: list[str]) -> list[bool]:
        """Whether a text may hold such a term; texts with other characters always may."""
        held = [set(ascii_terms(t)) if t.isascii() else None for t in texts]
        if len(self.known) >= HELD_TERMS:
            self.known = {}
        known = self.known
        new = list({w for words in held if words for w in words if w not in known})
        known.update(zip(new, self.likely.has(np.array([digest(w) for w in new], np.int64)).tolist()))
        return [words is None or any(map(known.__getitem__, words)) for words in held]


def term_uses(terms: list[str], window: int) -> list[tuple[str, int, int]]:
    """(term, context, first) of a text's different terms and contexts; first is 1 once for each term."""
    out, seen = [], set()
    for i, term in enumerate(terms):
        context = digest(" ".join([*terms[max(0, i - window):i], "", *terms[i + 1:i + 1 + window]]))
        if (term, context) not in seen:
            out.append((term, context, int(term not in seen)))
            seen |= {term, (term, context)}
    return out


def found_data(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(doc, row, spans, entities, uses, counts) of every row, and rows of counts alone.

    uses: the terms of a text that holds an entity. Where counts is not null the row is of no
    document: it holds numbers of documents by term, to be added up.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, row bigint, spans {SPANS}, entities array<bigint>, uses {USES}, counts {COUNTS}"
    span_type, use_type, count_type = (
        pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])),
        pa.list_(pa.struct([("term", pa.string()), ("context", pa.int64()), ("first", pa.int32())])),
        pa.list_(pa.struct([("term", pa.string()), ("n", pa.int64())])))
    names = ["doc", "row", "spans", "entities", "uses", "counts"]

    def named(rows, kind):
        fields = [f.name for f in kind.value_type]
        return pa.array([[dict(zip(fields, x)) for x in row] for row in rows], kind)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, id_type, lower = Counter(), None, Terms()

        def counted():
            items = list(counts.items())
            parts = [items[at:at + 4096] for at in range(0, len(items), 4096)]
            nothing = [pa.nulls(len(parts), t) for t in (id_type, pa.int64(), span_type, pa.list_(pa.int64()), use_type)]
            counts.clear()
            return pa.RecordBatch.from_arrays([*nothing, named(parts, count_type)], names=names)

        for batch in small_batches(batches):
            id_type = batch.column(0).type
            texts = [t or "" for t in batch.column(2).to_pylist()]
            spans = [base_spans(t) for t in texts]
            entities, uses = [], []
            for text, found in zip(texts, spans):
                terms = lower.places(text, found)[0] if found or not text.isascii() else ascii_terms(text)
                counts.update(set(terms))
                entities.append(sorted({digest(f"{k}:{text[a:b].lower()}") for k, a, b in found}))
                uses.append(term_uses(terms, window) if found else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), named(spans, span_type), pa.array(entities, pa.list_(pa.int64())),
                 named(uses, use_type), pa.nulls(batch.num_rows, count_type)], names=names)
            if len(counts) >= HELD_TERMS:
                yield counted()
        if counts:
            yield counted()

    return docs.select(id_col, row_key(id_col, text_col), text_col).mapInArrow(find, schema)


def disclosing(found: DataFrame, support: int, generalise: float) -> DataFrame:
    """(term, disclosure) of the terms that reveal an entity, from counts over all documents."""
    rows = found.where("counts IS NULL")
    n = float(rows.count())
    held, _ = saved(
        rows.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
        .where(F.col("n_e").between(support, n - 1)), "repeated-values")
    used = (
        rows.where("size(entities) > 0").select(F.explode("entities").alias("entity"), "uses")
        .where(Bloom(held, "entity").may_hold("entity")).select("entity", F.inline("uses")))
    met = (
        used.groupBy("entity", "term", "context").agg(F.sum("first").alias("docs"))
        .groupBy("entity", "term").agg(F.sum("docs").alias("n_te"), F.count("*").alias("contexts"))
        .where((F.col("contexts") >= support) & (F.col("n_te") >= support)))
    terms = found.where("counts IS NOT NULL").select(F.inline("counts")).groupBy("term").agg(F.sum("n").alias("n_t"))
    share = F.log(n * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / F.log(F.lit(n) / F.col("n_e"))
    return (
        met.join(held, "entity").join(terms, "term")
        .select("term", share.alias("disclosure")).where(F.col("disclosure") >= generalise)
        .groupBy("term").agg(F.max("disclosure").alias("disclosure")))


def term_places(docs: DataFrame, id_col: str, text_col: str, likely: Bloom) -> DataFrame:
    """(doc, row, key, start, end) of the words outside the base spans that may be among the likely keys.

    key is the term's digest.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, some = Terms(lambda word: digest(word.lower())), LikelyTerms(likely)
        nothing = [np.empty(0, np.int64)] * 3
        for batch in small_batches(batches):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            found = [keys.places(t, base_spans(t)) if may else nothing for t, may in zip(texts, some.texts_with(texts))]
            columns = [np.concatenate([np.array(f[i], np.int64) for f in found]) for i in range(3)]
            stays = likely.has(columns[0])
            ends = np.r_[0, np.cumsum(stays)][np.cumsum([0, *(len(f[0]) for f in found)])]
            inner = pa.StructArray.from_arrays([pa.array(c[stays]) for c in columns], ["key", "start", "end"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)],
                names=["doc", "row", "places"])

    schema = f"doc {kind}, row bigint, places array<struct<key: bigint, start: bigint, end: bigint>>"
    found = docs.select(id_col, row_key(id_col, text_col), text_col).mapInArrow(find, schema)
    return found.select("doc", "row", F.inline("places"))


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8, support: int = 3,
                   generalise: float = 0.6) -> DataFrame:
    """(doc, row, spans, terms): base spans, and the disclosing terms with their disclosure, of every row."""
    found, _ = saved(found_data(docs, id_col, text_col, window), "personal")
    shown, _ = saved(disclosing(found, support, generalise).groupBy(F.xxhash64("term").alias("key")).agg(
        F.max("disclosure").alias("disclosure")), "disclosing")
    terms = (
        term_places(docs, id_col, text_col, Bloom(shown, "key")).join(shown, "key")
        .groupBy("doc", "row", "start", "end").agg(F.max("disclosure").alias("disclosure"))
        .groupBy(F.col("doc").alias("__doc"), F.col("row").alias("__at"))
        .agg(F.sort_array(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms")))
    rows = found.where("counts IS NULL")
    return rows.join(
        terms, rows["doc"].eqNullSafe(terms["__doc"]) & (rows["row"] == terms["__at"]), "left").select(
        "doc", "row", "spans", F.coalesce("terms", F.array().cast(TERM_SPANS)).alias("terms"))


def replaced(text: str, marks: list[tuple[int, int, str]]) -> str:
    """text with every run of overlapping marks replaced by the first one's mark."""
    out, at = [], 0
    for start, end, mark in sorted(marks):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = 0.9, **settings) -> DataFrame:
    """docs with personal data and disclosing terms replaced by their kind, or removed."""
    spans = personal_spans(docs, id_col, text_col, **settings).where("size(spans) + size(terms) > 0").select(
        F.col("doc").alias("__doc"), F.col("row").alias("__at"), F.concat(
            F.transform("spans", lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("mark"))),
            F.transform("terms", lambda t: F.struct(
                t["start"].alias("start"), t["end"].alias("end"),
                F.when(t["disclosure"] >= remove, "").otherwise("[TERM]").alias("mark")))).alias("__marks")).dropDuplicates(["__doc", "__at"])
    spans = small_table(spans, "personal-marks", F.size("__marks"))
    keyed = docs.withColumn("__row", row_key(id_col, text_col))
    joined = keyed.join(spans, keyed[id_col].eqNullSafe(spans["__doc"]) & (keyed["__row"] == spans["__at"]), "left")
    ready = joined.select(*docs.columns, "__marks")
    place = docs.columns.index(text_col)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            marks = batch.column(batch.num_columns - 1).to_pylist()
            texts = [t if not m else replaced(t, [(x["start"], x["end"], x["mark"]) for x in m])
                     for t, m in zip(batch.column(place).to_pylist(), marks)]
            columns = [pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return ready.mapInArrow(rewrite, docs.schema)


def joined_spans(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query("op8_pii")
def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_spans(table(spark, folder, "documents").select("doc_id", "text"))
    terms = F.transform("terms", lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    number = [_count("spans", k).alias(f"n_{k}") for k in KINDS]
    return found.select(
        F.col("doc").alias("doc_id"), *number, F.sha2(joined_spans("spans"), 256).alias("base_sha256"),
        joined_spans(F.concat("spans", terms)).alias("spans"))
