"""Packing: round trips, gapless sequences, exact optima of small instances."""

import random
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from asphalta.llm import packing, tokens
from asphalta.llm.common import text_batches
from asphalta.llm.packing import cut_documents, dominating_set, pack, pack_sizes, sequences
from asphalta.llm.tokens import WordEncoder, default_tokenizer


def optimum(items, capacity):
    """Fewest bins by search over all ways to place the pieces, largest first."""
    items = sorted(items, reverse=True)
    best = len(items)

    def place(at, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if at == len(items):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= items[at]}.values():
            place(at + 1, rooms[:i] + [rooms[i] - items[at]] + rooms[i + 1:])
        place(at + 1, rooms + [capacity - items[at]])

    place(0, [])
    return best


def sizes_of(items):
    return {s: items.count(s) for s in set(items)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_never_loses_the_optimum(items):
    counts = np.bincount(items, minlength=21) if items else np.zeros(21, np.int64)
    fixed = packing.reduce_sizes(counts)
    left = [s for s in range(21) for _ in range(counts[s])]
    assert sum(n for _, n in fixed) + optimum(left, 20) == optimum(items, 20)


def test_set_dominates_every_alternative():
    rng = random.Random(3)
    for _ in range(300):
        items = [rng.randrange(1, 15) for _ in range(rng.randrange(1, 7))]
        counts = np.bincount(items, minlength=15)
        j = max(items)
        chosen = dominating_set(counts, j)
        if chosen is None:
            continue
        others = list(items)
        others.remove(j)
        for n in range(1, len(others) + 1):
            for other in combinations(sorted(others, reverse=True), n):
                if sum(other) <= 14 - j:  # its pieces fit into the places of the chosen ones
                    assert optimum(list(other), 14) and fits(list(other), list(chosen))


def fits(pieces, places):
    if not pieces:
        return True
    return any(p >= pieces[0] and fits(pieces[1:], places[:i] + [p - pieces[0]] + places[i + 1:])
               for i, p in enumerate(places))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_patterns_hold_every_piece_once(items):
    patterns = pack_sizes(sizes_of(items), 30)
    held = [s for pattern, n in patterns for s, each in pattern for _ in range(each * n)]
    assert sorted(held) == sorted(items)
    assert all(sum(s * each for s, each in pattern) <= 30 for pattern, _ in patterns)
    used = sum(n for _, n in patterns)
    assert used <= max(1, -(-11 * max(1, -(-sum(items) // 30)) // 9) + 1) if items else used == 0


def test_counts_not_pieces_set_the_work():
    few, many = ({s: n * (1 + s % 7) for s in range(1, 4097)} for n in (1, 10 ** 9))
    a, b = pack_sizes(few, 4096), pack_sizes(many, 4096)
    assert len(b) < 20_000
    total = sum(s * n for s, n in many.items())
    assert sum(n for _, n in b) <= 1.001 * total / 4096 and len(a) < 20_000


def test_too_long_a_piece_is_refused():
    with pytest.raises(ValueError):
        pack_sizes({31: 1}, 30)


def test_words_encode_like_whole_texts():
    encoder = WordEncoder(default_tokenizer())
    plain = Tokenizer.from_file(default_tokenizer())
    texts = ["", None, "Hello, WORLD's don't 12345 ÉTÉ é", "a\x1cb c\x85d\xa0e　f ̈x", "Σίσυφος ΟΔΟΣ İstanbul",
             "<|endoftext|> x <|startoftext|>", "日本語 テキスト 🙂🙂 ​ z", "x" * 3000, "!!!  ...\n\n\tok"] * 2
    texts += ["Éß ÷ × ª ŉ ǰ İ ǅ word, word. word?! don't."] * 3
    assert encoder.encode(texts) == [np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_forms_of_a_word_are_kept_once():
    encoder, plain = WordEncoder(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    texts = ["Été été. ÉTÉ! été,", " WORD word;\u2003Word: word?\x85\n", ""]
    assert encoder.encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert sorted(w for w in encoder.words if w) == ["word", "été"]


def test_every_character_between_words():
    encoder, plain = WordEncoder(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    texts = [f"Ab{c}Cd{c}" for c in map(chr, [*range(0x300), *range(0x1680, 0x1690), *range(0x2000, 0x2070), 0x3000, 0xfeff])]
    assert encoder.encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_words_kept_in_two_generations(monkeypatch):
    monkeypatch.setattr(tokens, "WORDS_KEPT", 20)
    encoder, plain, rng = WordEncoder(default_tokenizer()), Tokenizer.from_file(default_tokenizer()), random.Random(2)
    for _ in range(60):
        texts = [" ".join(f"{rng.choice('aBcé')}{rng.choice('xyz')}{rng.choice(['', '.', ',,', '1'])}" for _ in range(9)) for _ in range(3)]
        assert encoder.encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert len(encoder.words) < 60


def test_ascii_words_go_to_the_model_alone(monkeypatch):
    """Normalising and cutting took most of the time of a new word."""
    encoder, plain, rng = WordEncoder(default_tokenizer()), Tokenizer.from_file(default_tokenizer()), random.Random(5)
    monkeypatch.setattr(encoder, "_plain_words", lambda words: [] if not words else pytest.fail(f"asked the library for {words[:3]}"))
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzQZ", k=rng.randrange(1, 15))) for _ in range(40)) for _ in range(20)]
    assert encoder.encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_batches_of_text_are_bounded():
    texts = ["a" * n for n in [5, 0, 30, 1, 1, 1, 1, 9, 200, 2]] + [None, "é" * 10]
    batch = pa.record_batch({"id": list(range(len(texts))), "text": texts})
    parts = [b.column(1).to_pylist() for b in text_batches(iter([batch, batch.slice(3, 4)]), 1, rows=3, size=20)]
    assert [t for p in parts for t in p] == texts + texts[3:7]
    assert all(len(p) <= 3 and (len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 20) for p in parts)


def test_pieces_and_places(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma,", "Delta's", "12", "é"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 5, 30, 200))))) for i in range(80)]
    rows += [(3, rows[3][1]), (None, None), (None, ""), (200, "word " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("offset", F.lit("x")).repartition(5)
    pieces = cut_documents(docs, capacity=64)
    placed = pack(pieces.withColumn("extra", F.col("piece")), capacity=64)
    got = placed.collect()
    plain = Tokenizer.from_file(default_tokenizer())
    want = []
    for d, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(d, p, 64 * p, np.array(ids[64 * p:64 * p + 64], "<u4").tobytes()) for p in range(-(-len(ids) // 64))]
    order = lambda x: (x[0] is not None, *map(str, x))
    assert sorted(((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in got), key=order) == sorted(want, key=order)
    filled = {}
    for r in got:
        assert r.length == len(r.ids) // 4 and r.extra == r.piece
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert len(filled) <= sum(len(w[3]) // 4 for w in want) / 64 * 1.1 + 2
    whole = sequences(placed).collect()
    assert sorted(r.sequence_id for r in whole) == sorted(filled)
    for r in whole:
        assert len(r.ids) == 4 * r.n_tokens == 4 * sum(n for _, n in filled[r.sequence_id])
        assert [zlib.crc32(x.ids) for x in sorted((g for g in got if g.sequence_id == r.sequence_id), key=lambda g: g.offset)] == [
            zlib.crc32(bytes(r.ids)[4 * o:4 * o + 4 * n]) for o, n in sorted(filled[r.sequence_id])]


def test_empty_table(spark):
    assert pack(cut_documents(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
