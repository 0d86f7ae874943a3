"""Benchmark decontamination against a plain scan of every window."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from asphalta.llm.decontamination import contamination, decontaminate, item_lists, op13_benchmark_decontamination, set_key

DOCS = "doc_id long, text string, words int, probe string"
ITEMS = "item_id string, text string, note string"
PASSAGE = "Alpha beta, gamma delta; epsilon zeta eta theta iota kappa lambda mu nu"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item or "")
    out = []
    for doc, text in docs:
        w, hit, held = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    held |= windows[tuple(w[i:i + n])]
        out.append((doc, len(w), tuple(sorted(hit)), tuple(sorted(held))))
    return Counter(out)


def mine(found, item_windows):
    found = found.withColumn("set_key", set_key())
    rows = found.join(item_lists(found, item_windows), "set_key", "left").collect()
    out = Counter()
    for r in rows:
        hit = tuple(p for s in r.spans for p in range(s.start, s.end))
        out[(r.doc, r.n_words, hit, tuple(r["items"] or ()))] += r.copies
    return out


ITEM_ROWS = [("b", PASSAGE), ("a", PASSAGE.upper()), ("c", "alpha beta gamma delta epsilon zeta eta theta iota kappa other end"),
             ("d", "short one"), ("e", "Ünique"), (None, "nameless item words"), ("f", None), ("g", " .,"), ("d", "second text of d"),
             ("h", "x x x x x x x x x x x x")]
DOC_ROWS = [
    (1, f"before {PASSAGE} after"), (2, PASSAGE), (2, PASSAGE), (3, None), (None, ""), (None, f"{PASSAGE} {PASSAGE}"),
    (4, "alpha beta gamma delta epsilon zeta eta theta iota"), (5, "a SHORT-one short; one ÜNIQUE Ünique"), (6, "shortone"),
    (7, "x " * 9), (8, "x " * 10), (9, "x " * 25), (10, "nameless item words second text of d"), (11, "w " * 20000 + PASSAGE)]
DOC_ROWS += [(100 + k, " ".join(["pad"] * k) + " " + PASSAGE) for k in range(12)]


@pytest.mark.parametrize("most", [500_000, 40])
def test_matches_plain_scan(spark, most):
    docs = spark.createDataFrame([(*r, 1, "x") for r in DOC_ROWS], DOCS).repartition(3)
    items = spark.createDataFrame([(*r, "n") for r in ITEM_ROWS], ITEMS)
    assert mine(*contamination(docs, items, most=most)) == plain(DOC_ROWS, ITEM_ROWS)


def test_other_window_sizes(spark):
    docs, items = spark.createDataFrame(DOC_ROWS, "doc_id long, text string"), spark.createDataFrame(ITEM_ROWS, "item_id string, text string")
    for size in (1, 2, 3, 7):
        assert mine(*contamination(docs, items, size=size)) == plain(DOC_ROWS, ITEM_ROWS, size)


def test_spans_or_documents_go(spark):
    docs = spark.createDataFrame([
        (1, f"Keep this. {PASSAGE}! And  this", 1), (2, "Ünchanged  text", 2), (3, None, 3), (4, f"{PASSAGE}", 4), (4, f"{PASSAGE}", 4)],
        "doc_id long, text string, n_words int")
    items = spark.createDataFrame([("b", PASSAGE)], "item_id string, text string")
    cut = decontaminate(docs, items)
    assert cut.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in cut.collect() if r.text is not None) == [
        (1, "Keep this. And  this"), (2, "Ünchanged  text"), (4, ""), (4, "")]
    assert sorted(r.doc_id for r in decontaminate(docs, items, remove="documents").collect()) == [2, 3]
    with pytest.raises(ValueError):
        decontaminate(docs, items, remove="lines")


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOC_ROWS, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id string, text string")
    found, _ = contamination(docs, none)
    assert all(not r.spans and not r.windows for r in found.collect()) and found.agg(F.sum("copies")).first()[0] == len(DOC_ROWS)
    assert contamination(docs.limit(0), none)[0].collect() == []


def test_query_on_whole_table(spark, tmp_path):
    spark.createDataFrame([(*r, 1, "x") for r in DOC_ROWS], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*r, "n") for r in ITEM_ROWS], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter(tuple(r) for r in op13_benchmark_decontamination(spark, str(tmp_path)).collect())
    want = Counter()
    for (doc, n, hit, held), k in plain(DOC_ROWS, ITEM_ROWS).items():
        want[(doc, n, len(hit), len(held), hashlib.sha256(",".join(held).encode()).hexdigest(), bool(hit))] += k
    assert got == want
