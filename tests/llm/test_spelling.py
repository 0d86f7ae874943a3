"""Spelling variants against a plain comparison of all words."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from asphalta.llm.spelling import SYMBOLS, corpus_words, letter_symbols, near_pairs, op12_spelling_variants, reduced, spelling_variants

KIND = "doc_id long, text string, word string, n int, run string"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_words(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def plain(words, ratio=10):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    best = {w: min(xs, key=lambda x: (-words[x], x)) for w, xs in near.items() if xs}
    form = {w: b for w, b in best.items() if words[b] >= ratio * words[w]}
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.add((w, words[w], len(near[w]), f, words[f] if f else None, root))
    return out


def words_frame(spark, words):
    return spark.createDataFrame([(w, n, "x", 1) for w, n in words.items()], "word string, n int, class string, size int").repartition(3)


CHAIN = {"separate": 9000, "seperate": 900, "seperat": 90, "seprat": 9, "aeparate": 3, "ñandúes": 50, "ñandues": 5, "mandúes": 5, "élanças": 2,
         "tieabcd": 40, "tieabce": 40, "tieabcf": 4, "lonely": 7, "x": 30, "y": 3, "": 2}


@pytest.mark.parametrize("crowd", [16, 2, 1, 0])
def test_matches_all_pairs(spark, crowd):
    words = CHAIN | {f"{a}{b}{c}word": 2 + ord(b) for a in "abefij" for b in "abcdé" for c in "aeimq"}
    got = {tuple(r) for r in spelling_variants(words_frame(spark, words), crowd=crowd).collect()}
    assert got == plain(words)


def test_crowded_classes_lose_no_pair(spark):
    words = {f"{'abcdefgh'[i % 8]}{'aeimquy'[j]}{'éàîõ'[k]}longer": 2 for i in range(8) for j in range(7) for k in range(4)}
    want = {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    for alphabets, crowd in (((4, 16, 64), 1), ((4,), 0), ((4, 64), 8), ((64,), 3)):
        pairs = [(r.a, r.b) for r in near_pairs(words_frame(spark, words).select("word", "n"), alphabets, crowd).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


@settings(max_examples=5, deadline=None)
@given(st.sets(st.text(alphabet="abeiÀÿx", min_size=1, max_size=5), min_size=1, max_size=40))
def test_any_words(spark, words):
    words = {w: 1 + (zlib.crc32(w.encode()) % 500) for w in words}
    assert {tuple(r) for r in spelling_variants(words_frame(spark, words), ratio=3, crowd=2).collect()} == plain(words, 3)


def test_larger_alphabets_split_smaller_ones(spark):
    weights = {c: 1000 - 7 * i for i, c in enumerate("etaoinshrdlucmfwypvbgkjqxzéàñ")}
    small, middle, large = letter_symbols(weights, (4, 16, 64))
    for fine, coarse in ((middle, small), (large, middle)):
        assert all(fine[c] // 4 == coarse[c] for c in weights)
    loads = [sum(weights[c] for c in weights if small[c] == k) for k in range(4)]
    assert max(loads) < 1.2 * min(loads)
    row = spark.createDataFrame([("eaté",)], "w string").select(reduced(F.col("w"), small).alias("r")).first()
    assert row.r == "".join(SYMBOLS[small[c]] for c in "eaté")


ROWS = [(i, f"Separate the {w} separated, {w}; ÉLANÇAS élanças × {'separate ' * (i % 40)}") for i, w in enumerate(["seperate", "Beautiful", "beautifull", "beutiful"] * 30)]
ROWS += [(None, None), (None, ""), (None, "separate separate"), (7, "separate " * 30000), (7, "separate " * 30000), (8, "word" * 10000)]


def test_query_on_whole_table(spark, tmp_path):
    spark.createDataFrame([(*r, "x", 1, "r") for r in ROWS], KIND).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in op12_spelling_variants(spark, str(tmp_path)).collect()}
    assert got == plain(plain_words(ROWS)) and any(r[3] for r in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], KIND)
    assert spelling_variants(corpus_words(docs, "doc_id", "text", 7, 31)).collect() == []
