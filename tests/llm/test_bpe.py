"""The backtracking coder against the tokenizers library."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from asphalta.llm import bpe
from asphalta.llm.bpe import Backtracking, decode, encode
from asphalta.llm.tokens import default_tokenizer

TEXTS = [
    "", " \n", "Hello, WORLD's don't I'LL we've 12345 3½ x²", "Σίσυφος ΟΔΟΣ İstanbul ﬁ ǅ Ⅷ Ⓐ", "<|endoftext|> x <|startoftext|>y<|endoftext|>",
    "<|ENDOFTEXT|> <|endoftext", "日本語 テキスト 🙂🙂 ​ z", "a\x1cb c\x85d\xa0e　f ̈x e ́", "ab" * 4000, "!!!??...\t—–", "\x00\x01\x7f"]


@pytest.fixture(scope="module")
def coder():
    return Backtracking(default_tokenizer())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


def same(coder, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return coder.encode(text) == ids and coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_fixed_texts(coder, library):
    assert all(same(coder, library, t) for t in TEXTS)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_any_text(coder, library, text):
    assert same(coder, library, text)


def test_random_words(coder, library):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeinorstthelué'.!0") for _ in range(rng.randrange(1, 40))) for _ in range(5000)]
    assert all(same(coder, library, w) for w in words)


def test_tokens_keep_their_own_border(coder):
    for token in range(600, len(coder.text_of), 997):
        left, right = coder.halves[token]
        assert not coder.compatible(left, right) and coder.word(coder.text_of[token]) == [token]


def test_rows(spark, library):
    rows = list(enumerate(TEXTS)) + [(None, None), (0, TEXTS[2]), (0, TEXTS[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("decoded", F.lit(1)).withColumn("extra", F.lit("e"))
    got = decode(encode(docs)).collect()
    want = [(d, t, library.encode(t or "", add_special_tokens=False).ids) for d, t in rows]
    assert sorted((str(r.doc_id), str(r.text), r.ids, r.decoded, r.extra) for r in got) == sorted(
        (str(d), str(t), ids, library.decode(ids, skip_special_tokens=False), "e") for d, t, ids in want)
    assert decode(encode(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_id_lists_of_nulls_empties_and_slices():
    """Lists cut from one list of values, without an object made for each value of the column."""
    column = pa.array([[1, 2], None, [], [3], [4, 5, 6]], pa.list_(pa.int32()))
    assert bpe.id_lists(column) == [[1, 2], [], [], [3], [4, 5, 6]]
    assert bpe.id_lists(column.slice(1, 3)) == [[], [], [3]] and bpe.id_lists(column.slice(5)) == []
