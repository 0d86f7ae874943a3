"""SimHash groups against brute force: all pairs of a small fixture."""

import random
import tracemalloc

import numpy as np
import xxhash
from pyspark.sql import functions as F

from asphalta.llm import simhash
from asphalta.llm.bloom import Bloom
from asphalta.llm.common import row_key
from asphalta.llm.components import components
from asphalta.llm.simhash import agreeing_blocks, drop_near_copies, link_buckets, near_links, pair_buckets, shingle_sets, simhash_groups


def plain_fingerprint(text, size=4):
    words, word = [], ""
    for ch in (text or "") + " ":
        if ch in " \t\n\x0b\x0c\r":
            words, word = (words + [word] if word else words), ""
        else:
            word += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
    if not words:
        return 0
    shingles = [words[i:i + size] for i in range(len(words) - size + 1)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(values, radius):
    """Lowest linked index by all pairs."""
    label = list(range(len(values)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


def near_values(rng, n):
    base = [rng.getrandbits(64) for _ in range(n // 6)]
    return [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(8))) for b in base for _ in range(6)]


def test_groups_match_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = ["wort%d" % i for i in range(300)]
    texts = [None, "", " \t\n", "one two", "One  TWO", "É accent", "é accent", "x " * 3000]
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 200))]
        for _ in range(rng.randrange(1, 5)):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts)) + [(ids[8], texts[8]), (None, texts[9])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).repartition(3)
    got = sorted((r.doc_id is not None, r.doc_id, r.fingerprint, r.component_id) for r in simhash_groups(docs).collect())
    values = [plain_fingerprint(t) for _, t in rows]
    label = groups_of(values, 4)
    least = {g: min(rows[i][0] for i in range(len(rows)) if label[i] == g and rows[i][0] is not None) for g in set(label)}
    assert got == sorted((d is not None, d, f"{v:016x}", least[g]) for (d, _), v, g in zip(rows, values, label))


def test_empty_table(spark):
    assert simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shards_of_a_large_bucket_lose_no_link(spark):
    rng = random.Random(9)
    values = sorted(set(near_values(rng, 240)))
    nodes = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v, v) for v in nodes], "node long, fp long")
    one_bucket = lambda f: f.select(F.lit(1).cast("long").alias("place"), "node", "fp")
    for routes, shard in ((agreeing_blocks(6, 4), 8192), (one_bucket, 16), (one_bucket, 1000)):
        found = components(near_links(fps, routes, 4, shard)).collect()
        group = {n: n for n in nodes} | {r.node: r.component for r in found}
        label = groups_of(values, 4)
        parts = {}
        for n, g in zip(nodes, label):
            parts.setdefault(g, set()).add(n)
        mine = {}
        for n in nodes:
            mine.setdefault(group[n], set()).add(n)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, parts.values()))


def test_trees_follow_only_edges_within_the_radius():
    rng = random.Random(2)
    values = np.array(near_values(rng, 600), np.uint64)
    bucket = np.sort(np.array([rng.randrange(5) for _ in values]))
    on = np.ones(len(values), bool)
    label = link_buckets(values[:, None], bucket, on, on, 4, chunk=64)
    expect = np.concatenate([np.array(groups_of([int(v) for v in values[bucket == b]], 4)) + np.flatnonzero(bucket == b)[0]
                             for b in np.unique(bucket)])
    assert (label == expect).all()
    tree = simhash.build_trees(values[:, None], np.zeros(len(values), np.int64))
    for node in range(len(values)):
        kids = tree["kids"][tree["low"][node]:tree["high"][node]]
        assert len(set(tree["key"][kids])) == len(kids)
        assert all(int(values[k] ^ values[node]).bit_count() == tree["key"][k] for k in kids)


def test_components_of_chain_star_and_loops(spark):
    chain = [(i, i + 1) for i in range(10, 40)]
    star = [(100, 100 + i) for i in range(1, 50)]
    edges = spark.createDataFrame(chain + star + star + [(7, 7), (None, 3), (-5, 100)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, **{100 + i: -5 for i in range(50)}, -5: -5}


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(11)
    vocabulary = ["w%d" % i for i in range(4000)]
    rows, groups = [], {}
    for g in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(120, 400))]
        for c in range(rng.randrange(1, 5)):
            copy = list(words)
            for _ in range(c):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            groups.setdefault(g, []).append(len(rows))
            rows.append((len(rows), " ".join(copy)))
    half = [rng.choice(vocabulary) for _ in range(200)]
    rows += [(900, " ".join(half)), (901, " ".join(half[:100] + [rng.choice(vocabulary) for _ in range(100)]))]
    rows += [rows[0], rows[0], (None, rows[5][1]), (None, "alone with no id"), (950, None), (951, ""), (952, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).repartition(4)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    expect = sorted([min(g) for g in groups.values()] + [900, 901, 950, -1])
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == expect
    assert drop_near_copies(docs.where("doc_id < 0")).collect() == []


def test_sets_of_chosen_rows_take_one_python_worker(spark):
    texts = ["one two three four five", "six seven eight nine", "ten eleven twelve", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    keys = docs.where("id in (0, 3)").select(row_key("id", "text").alias("row"))
    sets = shingle_sets(docs, "id", "text", 2, Bloom(keys, "row"))
    got = {r.node: r.shingles for r in sets.collect()}
    for text in (texts[0], None):
        hashes = np.unique(simhash.shingle_hashes(text, 2))
        assert got[simhash.set_hash(hashes)] == hashes.view(np.int64).tolist()
    assert simhash.set_hash(np.unique(simhash.shingle_hashes(texts[1], 2))) not in got
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 1


def test_near_copies_are_verified_exactly(spark):
    """Texts with a passage appended and with scattered edits, from far below the limit to above."""
    rng = random.Random(21)
    vocabulary = ["w%d" % i for i in range(5000)]
    rows, like = [], {}
    for pair in range(320):
        words = [rng.choice(vocabulary) for _ in range(300)]
        other = list(words)
        if pair % 2:
            other += [rng.choice(vocabulary) for _ in range(rng.choice([20, 60, 70, 74, 85, 100]))]
        else:
            for at in rng.sample(range(300), rng.choice([2, 5, 6, 7, 10])):
                other[at] = "new%d" % rng.randrange(9999)
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
        a, b = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (words, other))
        like[2 * pair + 1] = len(a & b) / len(a | b)
    kept = {r.doc_id for r in drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert {2 * p for p in range(320)} <= kept
    assert all(d in kept for d, j in like.items() if j < 0.8)
    close = [d in kept for d, j in like.items() if 0.8 <= j < 0.85]
    assert len(close) > 40 and sum(close) <= 0.05 * len(close)


def test_many_candidates_take_more_rounds(spark):
    """One bucket of texts that are alike but not alike enough, and copies of the last of them."""
    rng = random.Random(22)
    common = ["c%d" % i for i in range(170)]
    texts = [" ".join([*common, *("t%dx%d" % (t, i) for i in range(30))]) for t in range(12)]
    texts += [t + " end" for t in texts]
    ids = rng.sample(range(100), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    kept = {r.doc_id for r in drop_near_copies(docs, most=1).collect()}
    assert kept == {min(ids[t], ids[t + 12]) for t in range(12)}


def test_pairs_do_not_depend_on_the_queries_at_once():
    rng = np.random.default_rng(3)
    values = np.repeat(rng.integers(0, 1 << 63, (20, 4)).astype(np.uint64), 30, axis=0)
    bucket, on = np.repeat([0, 1, 2], 200), np.ones(600, bool)
    found = []
    for chunk in (40, 1000, 1 << 20):
        later, lower, more = pair_buckets(values, bucket, on, on, 55, 3, chunk)
        assert more and np.bincount(later).max() <= 3
        found.append(sorted(zip(later.tolist(), lower.tolist())))
    assert found[0] == found[1] == found[2]
    later, lower, more = pair_buckets(values, bucket, on, on, 55, 600, 40)
    same = (values[:, None] == values[None]).all(axis=2) & (bucket[:, None] == bucket[None])
    assert not more and set(zip(later.tolist(), lower.tolist())) == {
        (i, j) for i in range(600) for j in range(i) if same[i, j]}


def test_pairs_between_two_shards():
    values = np.zeros((12, 4), np.uint64)
    in_tree = np.arange(12) % 2 == 0
    later, lower, more = pair_buckets(values, np.zeros(12, np.int64), in_tree, ~in_tree, 55, 12, 8)
    assert not more and set(zip(later.tolist(), lower.tolist())) == {
        (max(i, j), min(i, j)) for i in range(0, 12, 2) for j in range(1, 12, 2)}


def test_memory_of_a_search_in_a_large_bucket():
    values = np.random.default_rng(4).integers(0, 1 << 63, (4096, 4)).astype(np.uint64)
    on = np.ones(4096, bool)
    tracemalloc.start()
    pair_buckets(values, np.zeros(4096, np.int64), on, on, 55, 2)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 50e6
