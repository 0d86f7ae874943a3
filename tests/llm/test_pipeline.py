"""The pipeline's stages, each against what the plain rules say about its own input."""

from collections import Counter
from pathlib import Path

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from asphalta.llm.pii import base_spans, personal_spans, replaced
from asphalta.llm.quality import LineRules, clean
from asphalta.llm.tokens import default_tokenizer

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="driver tables absent")
def test_every_stage_on_its_input(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    states = [{r.doc_id: r for r in docs.collect()}]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(DATA))
        out.write.parquet(path := f"{tmp_path}/{name}")
        docs = spark.read.parquet(path)
        if name != "best_fit_packing":
            assert docs.columns == columns
            states.append({r.doc_id: r for r in docs.collect()})
    raw, kept, deduped, single, private = states
    rules = LineRules()
    for d, r in raw.items():
        text, lost, s = clean(r.text, rules)
        good = s[0] >= 20 and 100 * s[4] <= 30 * s[0] and lost <= 0.5
        assert (d in kept) == good and (not good or kept[d].text == text)
    count = Counter(k for r in kept.values() for k in {x.strip().lower() for x in r.text.split("\n")} if k)
    seen = set()
    for d in sorted(kept):
        lines = []
        for x in kept[d].text.split("\n"):
            k = x.strip().lower()
            if count[k] < 10 or k not in seen:
                lines.append(x)
            if k and count[k] >= 10:
                seen.add(k)
        assert deduped[d].text == "\n".join(lines)
    shingles = {d: {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for d, r in deduped.items() for w in [r.text.lower().split()]}
    for a in deduped:
        for b in single:
            if b < a and len(shingles[a] & shingles[b]) >= 0.9 * len(shingles[a] | shingles[b]):
                assert a not in single
    for d in deduped.keys() - single.keys():
        assert any(len(shingles[d] & shingles[b]) >= 0.8 * len(shingles[d] | shingles[b]) for b in deduped if b != d)
    assert private.keys() == single.keys()
    assert not any(base_spans(r.text) for r in private.values())
    marks = {r.doc: [(s.start, s.end, f"[{s.kind.upper()}]") for s in r.spans] + [
        (t.start, t.end, "" if t.disclosure >= 0.9 else "[TERM]") for t in r.terms]
        for r in personal_spans(spark.read.parquet(f"{tmp_path}/simhash_near_dedup")).collect()}
    assert all(r.text == replaced(single[d].text, marks[d]) for d, r in private.items())
    library = Tokenizer.from_file(default_tokenizer())
    total, rows = 0, docs.collect()
    for r in rows:
        assert r.n_tokens <= 4096 and len(r.ids) == 4 * r.n_tokens
    lengths = [len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in private.values()]
    pieces = sorted((x for n in lengths for x in [4096] * (n // 4096) + [n % 4096] if x), reverse=True)
    left = []  # room left in the sequences of plain best fit, longest piece first
    for piece in pieces:
        fits = [i for i, room in enumerate(left) if room >= piece]
        if fits:
            left[min(fits, key=left.__getitem__)] -= piece
        else:
            left.append(4096 - piece)
    assert sum(r.n_tokens for r in rows) == sum(lengths) and -(-sum(lengths) // 4096) <= len(rows) <= len(left)
    assert {d for r in rows for d in r.doc_ids} == private.keys()


def test_stages_take_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.collect() == []
