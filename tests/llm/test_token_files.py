"""Token files: round trips, random access and ascending order."""

import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from asphalta.llm import token_files
from asphalta.llm.token_files import TokenFile, file_bytes, read_token_files, write_token_files
from asphalta.llm.tokens import default_tokenizer
from asphalta.session import fresh_path


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2 ** 32 - 1)), max_size=40), max_size=20))
def test_file_round_trip(documents):
    ids = np.array([i for d in documents for i in d], np.uint32)
    names = pa.array(range(100, 100 + len(documents)), pa.int64())
    file = TokenFile(file_bytes(names, np.array(list(map(len, documents)), np.int64), ids))
    assert file.ids().tolist() == ids.tolist()
    assert [file.token(i) for i in range(len(ids))] == ids.tolist()
    assert [file.document(i) for i in range(len(documents))] == documents and file.doc_ids.to_pylist() == names.to_pylist()


def test_rank_directory_over_many_steps():
    rng = random.Random(3)
    ids = np.array([rng.choice((5, 300, 70_000, 1 << 25)) for _ in range(5000)], np.uint32)
    file = TokenFile(file_bytes(pa.array([1]), np.array([len(ids)]), ids))
    assert len(file.levels) == 4 and all(file.token(i) == ids[i] for i in rng.sample(range(5000), 400))


def test_documents_come_back_in_order(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i * 3 % 101, " ".join(rng.choice(("alpha", "Beta,", "é", "7")) for _ in range(rng.randrange(40)))) for i in range(101)]
    rows += [rows[4], (rows[5][0], "another text"), (None, None), (None, "x"), (500, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("name", F.lit("clash")).repartition(6)
    place = fresh_path(spark, "token-files")
    manifest = write_token_files(docs, place)
    stray = file_bytes(pa.array([999]), np.array([1]), np.array([5], np.uint32))
    token_files.put(place, "000000-000000-lost-attempt.dac", stray)
    got = sorted(read_token_files(spark, place, manifest).collect(), key=lambda r: r.start)
    plain = Tokenizer.from_file(default_tokenizer())
    want = {}
    for d, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        want.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at, mine = 0, {}
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order) and len(got) == len(rows)
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
        mine.setdefault(r.doc_id, []).append((r.n_tokens, zlib.crc32(r.ids)))
    assert {d: sorted(x) for d, x in mine.items()} == {d: sorted(x) for d, x in want.items()}


def test_empty_table(spark):
    place = fresh_path(spark, "token-files")
    manifest = write_token_files(spark.createDataFrame([], "doc_id long, text string"), place)
    assert manifest.collect() == [] and read_token_files(spark, place, manifest).collect() == []
