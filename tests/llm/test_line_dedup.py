"""Line dedup against a plain count of lines."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from asphalta.llm.line_dedup import dedup_lines


def plain(rows, min_docs):
    def key(line):
        bare = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in bare)

    texts = [(t or "").split("\n") for _, t in rows]
    count = Counter(k for lines in texts for k in {key(x) for x in lines} if k)
    return [(d, len(lines), sum(count[key(x)] >= min_docs for x in lines),
             "\n".join(x for x in lines if count[key(x)] < min_docs)) for (d, _), lines in zip(rows, texts)]


def test_matches_plain_count(spark):
    rows = [(i, f"own {i}\n  Shared LINE \nÉcole\n\n{'x' if i % 2 else 'X'}y") for i in range(30)]
    rows += [(100 + i, "école\nÉCOLE\nécole ") for i in range(12)]
    rows += [(7, "shared line\r\nrepeated\nrepeated\nrepeated")] * 3 + [(None, None), (None, ""), (None, "shared line")]
    rows += [(500, "a\n" * 5000 + "\tshared line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"n_dropped": F.lit("old"), "pos": F.lit(1), "key": F.lit(2), "doc": F.lit(3)}).repartition(4)
    got = dedup_lines(docs, batches=4)
    assert got.columns == ["doc_id", "text", "pos", "key", "doc", "n_lines", "n_dropped"]
    mine = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()]
    order = lambda x: (x[0] is not None, x[0] or 0, hashlib.md5(x[3].encode()).hexdigest())
    assert sorted(mine, key=order) == sorted(plain(rows, 10), key=order)


def test_batches_and_levels_give_the_same(spark):
    rows = [(i, "\n".join(f"line {i % m}" for m in (2, 3, 5, 7, 11, 13))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for batches, fanout in ((1, 2), (5, 2), (7, 3)):
        mine = [(r.doc_id, r.n_lines, r.n_dropped, r.text)
                for r in dedup_lines(docs, batches=batches, fanout=fanout).collect()]
        assert sorted(mine) == sorted(plain(rows, 10))


def test_first_line_can_stay(spark):
    rows = [(i, f"own {i}\nshared\n shared") for i in range(5, 30)] + [(40, "SHARED")] * 2
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), keep_first=True).collect()
    texts = {r.doc_id: r.text for r in got}
    assert texts[5] == "own 5\nshared" and texts[6] == "own 6" and texts[40] == "" and len(got) == len(rows)


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
