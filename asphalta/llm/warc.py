"""Content-addressed web archive.

Payload bytes are stored once, under their SHA-256; the exact record headers stand in a
table of their own, with the digest. Records are put together again by joining the two.

Of the records with equal payloads of at least `min_payload` bytes the one with the
smallest page number is the response and the others are revisits that refer to it;
shorter payloads are all responses. Reading verifies every stored payload against the
digest it is filed under; one that fails makes the read fail.

Defined cases: a null page is an empty payload; a null url gives an empty target; line
breaks in a url are written percent-encoded, so that a header stays one line; rows
repeated in page number and payload are all responses; a null page number sorts after
the others, and refers_to is null where such a page is the response; an empty table
gives an empty archive; extra columns are not stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import fresh_path
from .common import query, saved, table

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _payloads(pages: DataFrame, html_col: str) -> DataFrame:
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    return pages.select("*", payload.alias("__payload")).withColumn("__digest", F.sha2("__payload", 256))


def _header(kind: Column) -> Column:
    """The record's header, from its version to the empty line."""
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")

    def name(page: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))

    refers = F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")), F.lit(f"\r\nWARC-Profile: {PROFILE}\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), name(F.col("page")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url, F.lit("\r\n"),
        F.when(kind == "revisit", refers).otherwise(""),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.when(kind == "revisit", F.lit(0)).otherwise(F.col("bytes")).cast("string"), F.lit("\r\n\r\n"))


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", html_col: str = "html",
                  min_payload: int = 100) -> None:
    """Write folder/payloads (digest, payload) and folder/headers (digest, header)."""
    rows = _payloads(pages, html_col)
    narrow, _ = saved(rows.select(
        F.col(id_col).alias("page"), "url", F.col("__digest").alias("digest"),
        F.octet_length("__payload").cast("long").alias("bytes")), "page-digests")
    firsts = narrow.groupBy("digest").agg(F.min("page").alias("first"))
    kind = F.when((F.col("bytes") < min_payload) | F.col("page").eqNullSafe(F.col("first")), "response").otherwise("revisit")
    narrow.join(firsts, "digest").select("digest", _header(kind).alias("header")).write.parquet(f"{folder}/headers")
    # Copies fall together in the task that reads them, before anything moves.
    rows.groupBy(F.col("__digest").alias("digest")).agg(F.first("__payload").alias("payload")).write.parquet(f"{folder}/payloads")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: header, its fields, and the payload, verified, that it stands for.

    record is the record as a WARC file holds it; a revisit holds no payload itself.
    """
    stored = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    actual = F.sha2("payload", 256)
    checked = stored.select(
        "digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(actual == F.col("digest"), actual).otherwise(F.raise_error(
            F.concat(F.lit("payload does not match its digest "), F.col("digest")))).alias("payload_digest"))
    headers = spark.read.schema("digest string, header string").parquet(f"{folder}/headers")

    def field(name: str, form: str) -> Column:
        return F.nullif(F.regexp_extract("header", f"\r\n{name}: {form}\r\n", 1), F.lit(""))

    fields = headers.select(
        "digest", "header", field("WARC-Type", "([a-z]+)").alias("record_type"),
        field("WARC-Record-ID", "<urn:page:([^>]*)>").alias("page"), field("WARC-Refers-To", "<urn:page:([^>]*)>").alias("refers_to"),
        field("WARC-Target-URI", "([^\r]*)").alias("url"))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return fields.join(checked, "digest").withColumn(
        "record", F.concat(F.col("header").cast("binary"), body, F.lit(b"\r\n\r\n"))).drop("digest")


def rebuilt(records: DataFrame) -> DataFrame:
    """records with payload_bytes and payload_digest of responses taken from the whole record.

    Every record is put together and must be as long as its header, its Content-Length and
    the closing line breaks say; one that is not makes the read fail.
    """
    head = F.octet_length("header")
    declared = F.regexp_extract("header", "\r\nContent-Length: ([0-9]+)\r\n\r\n", 1).cast("int")
    sound = (F.octet_length("record") == head + declared + 4) & (F.substring("record", F.lit(1), head) == F.col("header").cast("binary"))
    body = F.when(sound, F.substring("record", head + 1, declared)).otherwise(F.raise_error(
        F.concat(F.lit("record does not match its header: page "), F.coalesce("page", F.lit("null")))).cast("binary"))
    whole = records.withColumn("body", body)
    response = F.col("record_type") == "response"
    # A revisit's own body is empty; its payload is the one that it refers to.
    length, digest = F.octet_length("body").cast("long"), F.sha2("body", 256)
    return whole.withColumns({
        "payload_bytes": F.when(response, length).otherwise(F.col("payload_bytes") + length),
        "payload_digest": F.when(response, digest).otherwise(F.col("payload_digest"))}).drop("body")


@query("op7_warc_archive", """
 WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d FROM pages),
 n AS (
  SELECT page_id, d, CAST(octet_length(encode(h)) AS BIGINT) AS bytes, min(page_id) OVER (PARTITION BY d) AS first FROM p)
 SELECT page_id, bytes AS payload_bytes, d AS payload_digest,
  CASE WHEN bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM n""")
def op7_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    place = fresh_path(spark, "archive")
    write_archive(table(spark, folder, "pages"), place)
    return rebuilt(read_archive(spark, place)).select(
        F.expr("try_cast(page AS bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.expr("try_cast(refers_to AS bigint)").alias("refers_to"))
