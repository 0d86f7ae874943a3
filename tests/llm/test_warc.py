"""The archive gives every record back as written, and notices damage."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from asphalta.llm import warc
from asphalta.llm.warc import read_archive, write_archive
from asphalta.session import fresh_path

LONG = "<p>" + "é" * 100


def pages():
    rows = [(i, f"http://a/{i}", LONG if i % 3 == 0 else f"{LONG} {i}") for i in range(20, 0, -1)]
    rows += [(50 + i, "http://short", "short") for i in range(3)]
    return rows + [(70, None, None), (71, "http://x\r\ny", ""), (None, "http://none", LONG), (3, "http://a/3", LONG), (90, "u", None)]


def test_records_come_back(spark):
    rows, place = pages(), fresh_path(spark, "archive")
    write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3), place)
    stored = spark.read.parquet(f"{place}/payloads").collect()
    assert len(stored) == len({r[2] or "" for r in rows})
    got = read_archive(spark, place).collect()
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    want = []
    for page, url, html in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and page != first[html or ""]
        want.append(("null" if page is None else str(page), hashlib.sha256(data).hexdigest(), "revisit" if again else "response",
                     str(first[html or ""]) if again else None, data))
    mine = [(r.page, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got]
    assert sorted(map(str, mine)) == sorted(map(str, want))
    for r in got:
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        assert head.decode() + "\r\n\r\n" == r.header and body.endswith(b"\r\n\r\n")
        assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(body) - 4
        assert r.record_type == "revisit" or body[:-4] == bytes(r.payload)
    assert {r.url for r in got if r.page == "71"} == {"http://x%0D%0Ay"}


def test_damage_is_noticed(spark):
    place, bad = fresh_path(spark, "archive"), fresh_path(spark, "archive")
    write_archive(spark.createDataFrame(pages(), "page_id long, url string, html string"), place)
    spark.read.parquet(f"{place}/payloads").withColumn("payload", F.concat("payload", F.lit(b"x"))).write.parquet(f"{bad}/payloads")
    spark.read.parquet(f"{place}/headers").write.parquet(f"{bad}/headers")
    with pytest.raises(Exception, match="does not match"):
        read_archive(spark, bad).collect()


def test_empty_table(spark):
    place = fresh_path(spark, "archive")
    write_archive(spark.createDataFrame([], "page_id long, url string, html string"), place)
    assert read_archive(spark, place).collect() == []


def test_query_rebuilds_every_record(spark, tmp_path, monkeypatch):
    pages = [(1, "http://a", "x" * 200), (2, "http://b", "x" * 200), (3, "http://c", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.record_type, r.payload_bytes) for r in warc.op7_warc_archive(spark, str(tmp_path)).collect()}
    assert got == {1: ("response", 200), 2: ("revisit", 200), 3: ("response", 0)}
    read = warc.read_archive
    for kind in ("response", "revisit"):
        cut = F.when(F.col("record_type") == kind, F.lit(b"short")).otherwise(F.col("record"))
        monkeypatch.setattr(warc, "read_archive", lambda s, f: read(s, f).withColumn("record", cut))
        with pytest.raises(Exception, match="record does not match its header"):
            warc.op7_warc_archive(spark, str(tmp_path)).collect()
