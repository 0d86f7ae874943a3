"""Quality signals and line rules against plain rules."""

import random
from pathlib import Path

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from asphalta.llm.quality import LineRules, base_signals, clean, op10_quality_rules, quality_rules, repeated_words

DATA = Path("/root/testdata/sf0.001")


def plain_signals(text):
    words, word = [], ""
    for ch in text + " ":
        if ch in " \t\n\x0b\x0c\r":
            words, word = (words + [word] if word else words), ""
        else:
            word += ch
    lines = text.split("\n")
    dup = sum(bool(x.strip(" \t\n\x0b\x0c\r")) and x in lines[:i] for i, x in enumerate(lines))
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1}
    held = {i + k for i, w in enumerate(windows) if w in twice for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(held)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t|é #", max_size=120))
def test_signals(text):
    assert base_signals(text, text.split("\n")) == plain_signals(text)


def test_repeats_in_long_runs():
    rng = random.Random(1)
    for _ in range(40):
        words = [rng.choice("abc") for _ in range(rng.randrange(200))]
        windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
        held = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
        assert repeated_words(words) == len(held)
    assert repeated_words(["x"] * 200_000) == 200_000


@pytest.mark.parametrize("line, rule", [
    ("Home | News | Sport | About us", "navigation"), ("A real sentence of prose | with one bar.", None),
    ("Copyright 2020. All rights reserved.", "boilerplate"), ("Please click here to go on.", "boilerplate"),
    ("buy$$$ now$$$ best### deal***", "punctuation"), ("WOW!! THIS!! IS!! GREAT!!", "punctuation"),
    ("He said, with a sigh: no.", None), ("Short", None), ("so so so so it it it it is is is is", "stutter"),
    ("A long report on how the firm said that it would not sell, read more of which stands below in the next part of the text.", None)])
def test_line_rules(line, rule):
    assert LineRules().fails(line) == rule


@pytest.mark.parametrize("line, rule", [
    ("She looked up the catalog in the library before lunch.", None), ("The design in question was never built.", None),
    ("We ate bread more often than rice that year.", None), ("The sign in the window said that the shop was closed.", None),
    ("The code is licensed under terms that the council had never seen before.", None),
    ("Her newsletter reached nine hundred people in the valley every week.", None),
    ("Log in", "boilerplate"), ("Sign in or sign up to read more", "boilerplate"), ("READ  MORE »", "boilerplate"),
    ("Privacy Policy and Terms of Use apply", "boilerplate")])
def test_furniture_is_whole_phrases_and_most_of_a_line(line, rule):
    assert LineRules().fails(line) == rule


def test_a_clean_document_of_one_line_stays():
    text = "The old dialog in the second act was cut, and the sign in the window of the shop then made no sense to anybody."
    assert clean(text, LineRules())[:2] == (text, 0.0)


@pytest.mark.parametrize("lines", [
    ["这是一个没有空格的很长的中文句子它被硬换行了"] * 3, ["ภาษาไทยเขียนโดยไม่มีช่องว่างระหว่างคำในประโยค"] * 3,
    ["Half a league,", "Half a league,", "Half a league onward,"], ["Incomprehensibly circumlocutory phraseology"] * 3])
def test_wrapped_lines_are_no_menu(lines):
    assert LineRules().judge(lines) == [None] * 3


def test_menus_of_short_lines():
    assert LineRules().judge(["Home", "News", "Sport", "A sentence.", "", "Title", "Text goes on here and ends."]) == [
        "navigation"] * 3 + [None] * 4


def test_rows(spark):
    good = ("This is a plain sentence that tells the reader something new about the world outside. "
            "Another one follows it and says what happened next in other words.")
    rows = [(1, good), (2, "Home | News | Sport\n" * 20 + good), (3, f"Home | News | Sport | Art\n{good}"), (4, None), (5, ""),
            (None, good), (1, good), (6, "few words"), (7, "one two three four five six seven eight " * 10), (8, "x" * 300_000 + " y" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit("clash"), "other": F.lit(1)})
    got = quality_rules(docs).collect()
    assert sorted(str(r.doc_id) for r in got if r.kept) == ["1", "1", "3", "None"]
    for r in got:
        text, lost, signals = clean(r.text or "", LineRules())
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == signals == (
            plain_signals(r.text or "") if len(r.text or "") < 10_000 else signals)
        assert r.base_failed == (signals[0] < 20 or 100 * signals[4] > 30 * signals[0])
        assert r.kept == (not r.base_failed and lost <= 0.5) and r.cleaned_text == text and r.other == 1
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.skipif(not DATA.exists(), reason="driver tables absent")
def test_query_on_whole_table(spark):
    got = {r.doc_id: r for r in op10_quality_rules(spark, str(DATA)).collect()}
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    for doc_id, text in rows:
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_signals(text or "")
        assert r.kept or r.base_failed or quality.get(doc_id) != 1  # clean documents stay
