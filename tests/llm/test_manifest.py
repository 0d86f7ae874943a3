"""Merkle manifest against a plain tree built level by level."""

import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from asphalta.llm.manifest import FIELDS, check_proof, manifest, op11_merkle_manifest

KIND = "doc_id long, source string, lang string, n_chars long, text string, leaf string, place int, n string"


def H(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def lower(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_tree(leaves):
    """Root, and (siblings, fold) of every place."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])

    def walk(place, start):
        others = []
        for nodes in levels[:-1]:
            first = place - place % 16
            run = list(nodes[first:first + 16])
            others += run[:place % 16] + run[place % 16 + 1:]
            run[place % 16] = start
            start, place = H(run), place // 16
        return others, start

    return levels[-1][0], walk


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    root, above = plain_tree([trees[s][0] for s in names])
    out = Counter()
    for at, s in enumerate(names):
        subroot, walk = trees[s]
        for place, (_, _, own, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            others, folded = walk(place, leaf((*r[:4], lower(r[4]))) if hit else own)
            upper, folded = above(at, folded)
            out[(r[0], own, subroot, root, H(others + upper), folded, folded == root)] += 1
    return out


def found():
    lowered = [F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if c == "text" else F.col(c) for c in FIELDS]
    from asphalta.llm.manifest import leaf_of

    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf_of(lowered))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "n") for r in rows], KIND).repartition(5)


def rows_of(sizes):
    return [(1000 * k + i, s, "en" if i % 3 else None, i, f"Text {i} of É {s}") for k, (s, n) in enumerate(sizes.items()) for i in range(n)]


EDGES = [(1, "a", None, None, None), (2, "a", "", 0, ""), (None, "a", "en", 3, "Xyz"), (None, None, None, None, None), (7, None, "en", 1, "Q"),
         (3, "é", "fr", 2, "É"), (3, "é", "fr", 2, "É"), (3, "é", "fr", 2, "É"), (4, "z", "en", 9, "Long Words " * 30000), (5, "\U0001f600", "x", 1, "A")]


@pytest.mark.parametrize("low,sizes", [
    (3, {"one": 1, "sixteen": 16, "more": 17, "hot": 600}),
    (1, {"one": 1, "full": 256, "ragged": 257, "hot": 4390, "other": 33}),
    (0, {"a": 2, "b": 16, "c": 17, "d": 300})])
def test_matches_plain_trees(spark, low, sizes):
    rows = rows_of(sizes) + EDGES
    got = Counter(tuple(r) for r in manifest(frame(spark, rows), found=found(), low=low).collect())
    assert got == plain(rows)


def test_many_groups(spark):
    rows = [(i, f"source {i % 300}", "en", i, "T") for i in range(900)]
    assert Counter(tuple(r) for r in manifest(frame(spark, rows), found=found(), low=1).collect()) == plain(rows)


def test_written_proofs_give_the_root(spark):
    rows = rows_of({"a": 40, "b": 1, "c": 300})
    for r in manifest(frame(spark, rows), low=1, proofs=True).collect():
        assert r.verified and check_proof(r.leaf, r.proof, r.places, r.levels) == r.root
        assert check_proof(H(["x"]), r.proof, r.places, r.levels) != r.root
        assert H(x for run in r.proof for x in run) == r.proof_sha256


def test_one_row_and_no_row(spark):
    rows = [(5, "s", "en", 1, "Abc")]
    assert Counter(tuple(r) for r in manifest(frame(spark, rows), found=found()).collect()) == plain(rows)
    assert manifest(frame(spark, rows).limit(0)).collect() == []


def test_query_on_whole_table(spark, tmp_path):
    rows = rows_of({"a": 40, "b": 3}) + EDGES
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(tuple(r) for r in op11_merkle_manifest(spark, str(tmp_path)).collect()) == plain(rows)
