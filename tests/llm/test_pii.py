"""Base spans against the patterns themselves, disclosure against plain counts."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from asphalta.llm.bloom import Bloom
from asphalta.llm.pii import LikelyTerms, Terms, ascii_terms, base_spans, digest, luhn, op8_pii, personal_spans, replaced, sanitise

DATA = Path("/root/testdata/sf0.001")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def holds(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 8 <= len(digits) <= 15

    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if holds(k, m[0])]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab1920.@-+ %_()5é\n", max_size=60))
def test_spans_are_the_patterns(text):
    assert base_spans(text) == plain_spans(text)


def test_planted_spans():
    text = ("Mail a.b@c.org, x@y@z.de or 1.2.3.4.5.6.7.8 and 300.1.1.1, card 4111 1111 1111 1111 or 4111-1111-1111-1112,"
            " call +49 (30) 123-4567. or +1 23")
    assert base_spans(text) == plain_spans(text)
    assert [k for k, *_ in base_spans(text)] == ["email", "email", "ip", "ip", "card", "phone"]


def test_long_texts_take_no_longer_for_hostile_input():
    for text in ("a" * 400_000 + "@", "1" * 400_000, "1." * 200_000, "+1" + " " * 400_000, "a@" * 200_000, "1 " * 200_000):
        assert len(base_spans(text)) <= 200_000


def test_marks_that_overlap_are_one():
    assert replaced("abcdefgh", [(1, 3, "[X]"), (2, 5, "[Y]"), (6, 7, "")]) == "a[X]fh"


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(alphabet=[*map(chr, range(128)), "é", "İ"], max_size=40), max_size=6), st.integers(0, 9))
def test_ascii_texts_have_the_same_terms(texts, some):
    class Likely:
        def has(self, keys):
            return keys % 10 == some

    asked = LikelyTerms(Likely())
    for _ in range(2):
        for text, may in zip(texts, asked.texts_with(texts)):
            terms = Terms().places(text, [])[0]
            if text.isascii():
                assert ascii_terms(text) == terms
            assert may == (not text.isascii() or any(digest(w) % 10 == some for w in terms))


def plain_terms(text):
    """(term, start, end) of the runs of letters and numbers that overlap no base span."""
    spans = base_spans(text)
    return [(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W_]+", text) if not any(a < m.end() and m.start() < b for _, a, b in spans)]


def plain_disclosure(texts, window, support, generalise):
    """The highest share of a value's information that each term reveals, where it reaches the limit."""
    terms = [[w for w, _, _ in plain_terms(t)] for t in texts]
    values = [{(k, t[a:b].lower()) for k, a, b in base_spans(t)} for t in texts]
    n, n_t = len(texts), Counter(w for ws in terms for w in set(ws))
    n_e = Counter(e for es in values for e in es)
    n_te = Counter((w, e) for ws, es in zip(terms, values) for w in set(ws) for e in es)
    contexts = defaultdict(set)
    for ws, es in zip(terms, values):
        for i, w in enumerate(ws):
            for e in es:
                contexts[w, e].add((tuple(ws[max(0, i - window):i]), tuple(ws[i + 1:i + 1 + window])))
    shown = {}
    for (w, e), k in n_te.items():
        if len(contexts[w, e]) >= support and k >= support and n_e[e] < n:
            share = math.log(n * k / (n_t[w] * n_e[e])) / math.log(n / n_e[e])
            if share >= generalise:
                shown[w] = max(share, shown.get(w, share))
    return shown


def test_disclosure_matches_plain_counts(spark):
    rng = random.Random(4)
    filler = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    rows = []
    for i in range(60):
        words = [rng.choice(filler) for _ in range(12)]
        if i % 10 == 0:
            words[6:6] = ["surgeon", "Zeta", "boss@corp.example"]
        if i % 15 == 1:
            words[3:3] = ["common", "info@site.example"]
        rows.append((i, " ".join(words)))
    rows += [(100 + i, "common words only") for i in range(20)] + [(None, None), (None, ""), (7, rows[0][1]), (7, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "terms": F.lit(2)})
    shown = plain_disclosure([t or "" for _, t in rows], window=3, support=3, generalise=0.6)
    assert {"surgeon", "zeta"} <= shown.keys() and "common" not in shown
    got = Counter(
        (r.doc, tuple((t.start, t.end, round(t.disclosure, 9)) for t in r.terms))
        for r in personal_spans(docs, window=3, support=3, generalise=0.6).collect())
    assert got == Counter(
        (doc, tuple((a, b, round(shown[w], 9)) for w, a, b in plain_terms(text or "") if w in shown)) for doc, text in rows)
    cleaned = {r.doc_id: r.text for r in sanitise(docs, window=3, support=3).collect() if r.doc_id is not None}
    assert "boss@corp" not in cleaned[0] and "surgeon" not in cleaned[0] and "[EMAIL]" in cleaned[0]
    assert cleaned[100] == "common words only"


def test_terms_are_marked_wherever_they_stand(spark):
    """A term far from its value, short or with digits, and in a document without the value."""
    rng = random.Random(8)
    filler = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80)]
    gap = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = [(i, f"{gap(20)} boss@corp.example {gap(30)} Surgeon {gap(9)} wd7 {gap(30)} ox {gap(9)}") for i in range(5)]
    rows += [(10 + i, gap(60)) for i in range(90)] + [(200, f"{gap(5)} the surgeon of {gap(3)} WD7, ox.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cleaned = {r.doc_id: r.text for r in sanitise(docs).collect()}
    for i in (0, 1, 2, 3, 4, 200):
        words = set(re.findall(r"\w+", cleaned[i].lower()))
        assert not words & {"surgeon", "wd7", "ox"}
    assert all(cleaned[d] == text for d, text in rows if 10 <= d < 100)
    # Six documents hold the term, five of them with the value: log(96 * 5 / (6 * 5)) / log(96 / 5).
    spans = {r.doc: r.terms for r in personal_spans(docs).collect()}
    assert all(t.disclosure == pytest.approx(math.log(16) / math.log(96 / 5)) for d in (0, 200) for t in spans[d])
    assert len(spans[0]) == len(spans[200]) == 3


def test_values_of_few_documents_disclose_nothing(spark):
    """A rare word used often in the only document of a value, and in the only two of another."""
    rng = random.Random(5)
    filler = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(50)]
    gap = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    once = f"{gap(9)} glacier {gap(9)} glacier {gap(9)} glacier"
    rows = [(i, gap(20)) for i in range(40)] + [(50, f"{once} a@b.example"), (51, once.replace("glacier", "moraine"))]
    rows += [(60 + i, f"{gap(9)} tundra {gap(9)} tundra {gap(9)} c@d.example") for i in range(2)]
    cleaned = {r.doc_id: r.text for r in sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(cleaned[d] == re.sub(r"\S+@\S+", "[EMAIL]", text) for d, text in rows)


def test_bloom_filter_keeps_every_key(spark):
    rng = random.Random(6)
    keys = [rng.getrandbits(64) - (1 << 63) for _ in range(3000)]
    others = np.array([rng.getrandbits(64) - (1 << 63) for _ in range(20000)])
    rows = spark.createDataFrame([(k,) for k in [*keys, *keys[:50], None]], "key long")
    bloom = Bloom(rows, "key")
    assert bloom.has(np.array(keys)).all() and bloom.has(others).mean() < 0.02
    assert not bloom.has(np.array([], np.int64)).any()
    assert not Bloom(rows.where("key IS NULL"), "key").has(others).any()
    full = Bloom(rows, "key", most=10)  # far too small: all it may do is let others pass
    assert full.has(np.array(keys)).all() and len(full.words.value) == 16
    assert rows.where("key IS NOT NULL").where(bloom.may_hold("key")).count() == 3050


@pytest.mark.skipif(not DATA.exists(), reason="driver tables absent")
def test_query_on_whole_table(spark):
    got = {r.doc_id: r for r in op8_pii(spark, str(DATA)).collect()}
    for doc_id, text in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        spans = plain_spans(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        r = got[doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in spans) for kind in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert personal_spans(empty).collect() == [] and sanitise(empty).collect() == []
