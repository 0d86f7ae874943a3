"""Secret scan with corpus-wide ownership frequency, all in DataFrame functions.

Base spans are the matches of three patterns. Positions come from splitting a text by a
pattern and adding up the lengths of gaps and matches. A candidate is the value of a base
span or an opaque word: 20 or more characters of letters, digits, + / = _ - with at least
one lower-case letter, one upper-case letter and two digits. Candidates are
hashed, and each hash is counted over the corpus by distinct repositories and distinct
owners: copied widely (`copied` owners or more) it is an example, otherwise it belongs to
its owner and looks live. Opaque words that look live and lie outside all base spans are
added as spans of kind opaque; base spans stay, each with its verdict.

The tables at hand have no repository column: the owner defaults to `source`, the
repository to `source` and `lang` together.

Defined cases: a null text is empty; a null owner or repository counts as one of its own;
repeated rows count once for a repository, and each gives a row; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import query, row_key, saved, table

KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs too short to count are left to the gaps: they neither match nor hide a match.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OPAQUE = r"[A-Za-z0-9+/=_-]{20,}"
SPAN = "struct<kind: string, start: bigint, end: bigint, value: string>"
STEP = 256


def matches(text: Column, kind: str, pattern: str, group: int = 0) -> Column:
    """Spans of all matches from left to right; value is the given group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = whole if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(F.transform(gaps, F.char_length), F.transform(whole, F.char_length), lambda g, m: F.struct(
        g.cast("long").alias("gap"), F.coalesce(m, F.lit(0)).cast("long").alias("match")))
    # The gap after the last match takes no part.
    used = F.zip_with(F.slice(lengths, F.lit(1), F.size(whole)), values, lambda n, v: F.struct(
        n["gap"].alias("gap"), n["match"].alias("match"), v.alias("value")))
    zero = F.lit(0).cast("long").alias("at")
    none = F.struct(zero, F.array().cast(f"array<{SPAN}>").alias("spans"))
    nothing = F.struct(zero, F.array().cast(f"array<array<{SPAN}>>").alias("parts"))

    def step(done: Column, n: Column) -> Column:
        start = done["at"] + n["gap"]
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + n["match"]).alias("end"), n["value"].alias("value"))
        return F.struct((start + n["match"]).alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    def part(done: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(done["at"].alias("at"), none["spans"].alias("spans")), step)
        return F.struct(inner["at"].alias("at"), F.concat(done["parts"], F.array(inner["spans"])).alias("parts"))

    # STEP matches at a time, so that a text with very many of them is not copied for each.
    starts = F.when(F.size(used) > 0, F.sequence(F.lit(1), F.size(used), F.lit(STEP))).otherwise(F.array().cast("array<int>"))
    parts = F.transform(starts, lambda at: F.slice(used, at, F.lit(STEP)))
    return F.when(F.size(whole) == 0, none["spans"]).otherwise(
        F.flatten(F.aggregate(parts, nothing, part, lambda done: done["parts"])))


def candidates(docs: DataFrame, id_col: str, text_col: str, owner: Sequence[str], repository: Sequence[str]) -> DataFrame:
    """(doc, row, owner, repository, base, opaque) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(
        F.filter(matches(text, "assign", ASSIGN, 1), lambda s: F.char_length(s["value"]) >= 6),
        matches(text, "access", ACCESS), matches(text, "hex", HEX))
    mixed = F.filter(matches(text, "opaque", OPAQUE), lambda s: (
        s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9].*[0-9]")))
    named = lambda columns: F.to_json(F.struct(*columns))
    found = docs.select(
        F.col(id_col).alias("doc"), row_key(id_col, text_col).alias("row"), named(owner).alias("owner"),
        named(repository).alias("repository"), base.alias("base"), mixed.alias("mixed"))
    outside = F.filter("mixed", lambda o: ~F.exists("base", lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])))
    return found.select("doc", "row", "owner", "repository", "base", outside.alias("opaque"))


def ownership(found: DataFrame) -> DataFrame:
    """(key, owners, repositories, documents) of every candidate value, by its hash."""
    spans = found.select("owner", "repository", F.explode(F.concat("base", "opaque")).alias("s"))
    by_repository = spans.groupBy(F.md5(F.col("s.value").cast("binary")).alias("key"), "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("key", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("key").agg(
        F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("occurrences"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Sequence[str] = ("source",),
                 repository: Sequence[str] = ("source", "lang"), copied: int = 3) -> DataFrame:
    """(doc, base, spans) of every row; spans by start, each with kind, end, owners, repositories and verdict.

    The verdict is example for values of at least `copied` owners, else live.
    """
    found, _ = saved(candidates(docs, id_col, text_col, owner, repository), "secrets")
    owned = ownership(found)
    single = found.where("size(base) + size(opaque) > 0").dropDuplicates(["doc", "row"]).select(
        "doc", "row", F.explode(F.concat("base", "opaque")).alias("s"))
    keyed = single.select("doc", "row", "s.*", F.md5(F.col("s.value").cast("binary")).alias("key"))
    verdict = F.when(F.col("owners") >= copied, "example").otherwise("live")
    judged = keyed.join(owned, "key").withColumn("verdict", verdict).where("kind <> 'opaque' OR verdict = 'live'")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = judged.groupBy(F.col("doc").alias("__doc"), F.col("row").alias("__at")).agg(F.sort_array(F.collect_list(
        F.struct("start", rank.alias("rank"), "kind", "end", "owners", "repositories", "verdict"))).alias("spans"))
    kind = spans.schema["spans"].dataType.simpleString()
    return found.join(
        spans, found["doc"].eqNullSafe(spans["__doc"]) & (found["row"] == spans["__at"]), "left").select(
        "doc", "base", F.coalesce("spans", F.array().cast(kind)).alias("spans"))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _spans_sql(kind: str, pattern: str, group: int, test: str) -> str:
    """DuckDB: spans (rid, kind, start, end, value) of all matches that pass a test."""
    text = pattern.replace("'", "''").replace("\\x20", " ")
    return f"""
  SELECT rid, '{kind}' AS kind, head AS start, head + length(m) AS "end", value FROM (
   SELECT rid, whole[i] AS m, part[i] AS value,
    list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(whole[1:i-1], lambda g: length(g))), 0) AS head
   FROM (SELECT rid, unnest(range(1, len(whole) + 1)) AS i, whole, part, gaps FROM (
    SELECT rid, regexp_extract_all(text, '{text}') AS whole, regexp_extract_all(text, '{text}', {group}) AS part,
     regexp_split_to_array(text, '{text}') AS gaps FROM d))) WHERE {test}"""


OP6_SQL = f"""
 WITH d AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id, text) AS rid FROM documents),
 base AS ({_spans_sql("assign", ASSIGN, 1, "length(value) >= 6")} UNION ALL {_spans_sql("access", ACCESS, 0, "true")}
  UNION ALL {_spans_sql("hex", HEX, 0, "true")}),
 opaque AS (
  SELECT * FROM ({_spans_sql("opaque", OPAQUE, 0, "length(value) <= 200 AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9].*[0-9]')")}) o
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = o.rid AND b.start < o."end" AND o.start < b."end")),
 spans AS (SELECT * FROM base UNION ALL SELECT * FROM opaque),
 owned AS (SELECT s.value, count(DISTINCT coalesce(d.source, '(none)')) AS owners FROM spans s JOIN d USING (rid) GROUP BY s.value),
 kept AS (
  SELECT s.*, list_position(['assign', 'access', 'hex', 'opaque'], s.kind) AS place FROM spans s JOIN owned o ON s.value = o.value
  WHERE s.kind <> 'opaque' OR o.owners < 3)
 SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, place) FILTER (kind <> 'opaque'), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, place), '') AS spans
 FROM d LEFT JOIN kept k USING (rid) GROUP BY d.rid, d.doc_id"""


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query("op6_secret_scan", OP6_SQL)
def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_secrets(table(spark, folder, "documents").select("doc_id", "text", "source", "lang"))
    base = F.filter("spans", lambda s: s["kind"] != "opaque")
    return found.select(
        F.col("doc").alias("doc_id"), *[_count("base", k) for k in KINDS[:3]],
        F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))
