"""Merkle manifest of a dataset, with a proof for every row, by a butterfly exchange.

Leaves are SHA-256 digests of a row's fields. A group's leaves are in ascending order of
their id and every `FANOUT` consecutive nodes become one of the next level until one is
left, the subroot; the subroots in order of their groups make the root the same way.

Leaves are numbered within their group (`place`) by one range shuffle and offsets of
ranges, and dealt to aligned blocks of FANOUT ** low leaves. A block hashes its own
subtree. Then follow rounds: in round r the blocks whose numbers differ in digit r only
send each other the root of the subtree they hold, so that each learns its siblings'
roots, hashes the same parent and goes on with that. A block so gets its proof's upper
part without a pass downwards. In a group's ragged last subtree there are fewer blocks
than partners; they serve those in turn. The subroots, one a group, are leaves of a tree
of the same kind. Each block at last joins the upper parts of its proofs to its leaves.

Nothing but digests is shuffled after the leaves are hashed. A group of any size is many
blocks; a round's rows are FANOUT for each block.

Defined cases: null fields are written `-`; a null id or group comes first; rows of one id
are in order of their digests, so that equal rows are equal leaves next to each other;
groups are in order of their text; an empty table has no rows; very long texts are hashed
where they are read; columns that are not fields are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import lower_ascii, query, saved, sql_crc32, table

FANOUT = 16
#: Levels hashed inside one block, of FANOUT ** LOW leaves.
LOW = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCKS = "group string, block bigint, n bigint, root string, upper array<array<string>>"
GROUP_PROOFS = "name string, root string, group_place bigint, above array<array<string>>"
ROW_PROOFS = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(parts: Iterable[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each as its byte count, a colon and its value, or `-`."""
    def written(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(written, fields)), 256)


def levels_of(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def parents(nodes: list[str]) -> list[str]:
    return [digest(nodes[i:i + FANOUT]) for i in range(0, len(nodes), FANOUT)]


def placed(leaves: DataFrame, order: Sequence[str], low: int) -> DataFrame:
    """leaves with `place` (from 0 in their group), `n` (leaves of the group) and `block`.

    One range shuffle; a group's offset in a range is the sum of its counts in earlier ones.
    """
    columns = leaves.columns
    # Any number tells equal rows apart, so that many of them need not share a range.
    ranged = leaves.withColumn("any", F.monotonically_increasing_id()).repartitionByRange("group", *order, "any")
    numbered = ranged.sortWithinPartitions("group", *order, "any").withColumn("pos", F.monotonically_increasing_id())
    # Written, which fixes the numbers; the upper bits of a row's number name its range.
    stored, _ = saved(numbered.drop("any"), "manifest-ranges")
    part = F.shiftright("pos", 33)
    counts = stored.groupBy("group", part.alias("part")).agg(F.count("*").alias("size"), F.min("pos").alias("first"))
    in_group = Window.partitionBy("group")
    earlier = in_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("group").alias("of_group"), F.col("part").alias("of_part"),
        (F.coalesce(F.sum("size").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("size").over(in_group).alias("n"))
    joined = stored.withColumn("part", part).join(
        offsets, (F.col("part") == F.col("of_part")) & F.col("group").eqNullSafe(F.col("of_group")))
    place = F.col("pos") + F.col("shift")
    return joined.select(*columns, place.alias("place"), "n", F.floor(place / FANOUT ** low).cast("long").alias("block"))


def by_block(rows: DataFrame) -> DataFrame:
    """Every block whole in one task, in order of its places."""
    return rows.repartition("group", "block").sortWithinPartitions("group", "block", "place")


def blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The blocks of consecutive batches; none has more than FANOUT ** low leaves."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for _, block in groupby(rows, lambda r: (r["group"], r["block"])):
        yield list(block)


def table_of(rows: DataFrame, make, schema: str) -> DataFrame:
    """make(block) -> rows, for every block of rows, as a frame of schema."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for block in blocks_in(batches):
            held += make(block)
            if len(held) >= 1024:
                yield pa.RecordBatch.from_pylist(held, schema=kind)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=kind)

    return by_block(rows).mapInArrow(run, schema)


def block_root(low: int):
    def make(block: list[dict]) -> list[dict]:
        nodes, n = [r["leaf"] for r in block], block[0]["n"]
        for _ in range(min(low, levels_of(n))):
            nodes = parents(nodes)
        return [{"group": block[0]["group"], "block": block[0]["block"], "n": n, "root": nodes[0], "upper": []}]

    return make


def butterfly(blocks: DataFrame, low: int) -> DataFrame:
    """blocks with `root` of their whole group and `upper`: its nodes of every round's run, in order.

    Round r is for groups of more than FANOUT ** r blocks; all others are done by then.
    """
    blocks_of = F.ceil(F.col("n") / FANOUT ** low).cast("long")
    current, _ = saved(blocks, "manifest-round")
    most = current.agg(F.max(blocks_of)).first()[0] or 0
    done = []
    for r in range(levels_of(most)):
        span = FANOUT ** r  # blocks under one node
        done.append(current.where(blocks_of <= span))
        going = current.where(blocks_of > span)
        node = F.floor(F.col("block") / span).cast("long")
        first = F.col("node") - F.pmod("node", F.lit(FANOUT))
        last = F.least(first + FANOUT, F.ceil(blocks_of / span).cast("long")) - 1
        sent = going.select("group", "n", "root", node.alias("node"), F.pmod("block", F.lit(span)).alias("inside"))
        sent = sent.select("*", F.explode(F.sequence(first, last)).alias("sibling"))
        # A node's root goes to every block under its siblings and itself; where it has fewer
        # blocks than a sibling, each of them serves several.
        held = F.least(F.lit(span), blocks_of - F.col("node") * span)
        wanted = F.least(F.lit(span), blocks_of - F.col("sibling") * span)
        served = F.explode(F.sequence(F.col("inside"), wanted - 1, held)).alias("served")
        sent = sent.where(F.col("inside") < wanted).select("group", "n", "root", "node", "sibling", served)
        met = sent.select(
            F.col("group").alias("to_group"), (F.col("sibling") * span + F.col("served")).alias("to_block"), "node", "root")
        runs = met.groupBy("to_group", "to_block").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("node", "root"))), lambda x: x["root"]).alias("run"))
        held_by = F.col("group").eqNullSafe(F.col("to_group")) & (F.col("block") == F.col("to_block"))
        current, _ = saved(going.drop("root").join(runs, held_by).select(
            "group", "block", "n", F.sha2(F.array_join("run", ""), 256).alias("root"),
            F.concat("upper", F.array("run")).alias("upper")), "manifest-round")
    return reduce(DataFrame.union, [*done, current])


def trees(leaves: DataFrame, order: Sequence[str], low: int) -> tuple[DataFrame, DataFrame]:
    """Placed leaves (group, leaf and others), and blocks with their group's root and proof above them."""
    stored, _ = saved(placed(leaves, order, low), "manifest-leaves")
    roots = table_of(stored.select("group", "block", "place", "n", "leaf"), block_root(low), BLOCKS)
    return stored, saved(butterfly(roots, low), "manifest-blocks")[0]


def runs_of(block: list[dict], low: int) -> Iterator[tuple[dict, list[list[str]]]]:
    """Every leaf of a block, whose first row is the block's own, with its runs up to the group's root."""
    top, rows = block[0], block[1:]
    inner, nodes = [], [r["leaf"] for r in rows]
    for _ in range(min(low, levels_of(top["n"]))):
        inner.append([nodes[i:i + FANOUT] for i in range(0, len(nodes), FANOUT)])
        nodes = parents(nodes)
    for i, row in enumerate(rows):
        yield row, [runs[i // FANOUT ** (k + 1)] for k, runs in enumerate(inner)] + top["upper"]


def fold(leaf: str, place: int, runs: Sequence[Sequence[str]]) -> str:
    """The root that a leaf and its runs give, whatever the runs hold at the leaf's own place."""
    for run in runs:
        at = place % FANOUT
        leaf, place = digest([*run[:at], leaf, *run[at + 1:]]), place // FANOUT
    return leaf


def siblings(place: int, runs: Sequence[Sequence[str]]) -> list[list[str]]:
    """The others of every run, level by level."""
    out = []
    for run in runs:
        at, place = place % FANOUT, place // FANOUT
        out.append([*run[:at], *run[at + 1:]])
    return out


def with_blocks(leaves: DataFrame, blocks: DataFrame) -> DataFrame:
    """Leaves and, with a null place, the row of their block."""
    return leaves.unionByName(blocks, allowMissingColumns=True)


def group_proof(low: int):
    def make(block: list[dict]) -> list[dict]:
        return [{"name": row["name"], "root": block[0]["root"], "group_place": row["place"], "above": runs}
                for row, runs in runs_of(block, low)]

    return make


def row_proof(proofs: bool, low: int):
    def make(block: list[dict]) -> list[dict]:
        top, out = block[0], []
        for row, runs in runs_of(block, low):
            others = siblings(row["place"], runs) + siblings(top["group_place"], top["above"])
            subroot = fold(row["found"] or row["leaf"], row["place"], runs)
            folded = fold(subroot, top["group_place"], top["above"])
            out.append({
                "id": row["id"], "leaf": row["leaf"], "subroot": top["root"], "root": top["whole"],
                "proof_sha256": digest(x for run in others for x in run), "folded_root": folded,
                "verified": folded == top["whole"]} | ({
                    "proof": others, "places": [row["place"], top["group_place"]], "levels": len(runs)} if proofs else {}))
        return out

    return make


def check_proof(leaf: str, proof: Sequence[Sequence[str]], places: Sequence[int], levels: int) -> str:
    """The root that a leaf and its written proof give."""
    place = places[0]
    for k, others in enumerate(proof):
        if k == levels:
            place = places[1]
        at = place % FANOUT
        leaf, place = digest([*others[:at], leaf, *others[at:]]), place // FANOUT
    return leaf


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: Sequence[str] = FIELDS,
             found: Column | None = None, proofs: bool = False,
             low: int = LOW) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    found: the leaf as it is when proofs are checked, where it may differ from the recorded
    one (null: it does not). proofs: also give each proof, its places and how many of its
    levels lie below the subroot, which is what `check_proof` takes. low: levels hashed in a block.
    """
    leaves, _ = saved(docs.select(
        F.col(group_col).cast("string").alias("group"), F.col(id_col).alias("id"), leaf_of([F.col(c) for c in fields]).alias("leaf"),
        (F.lit(None) if found is None else found).cast("string").alias("found")), "manifest-digests")
    rows, blocks = trees(leaves, ["id", "leaf"], low)
    subroots = blocks.where("block = 0").select(
        F.lit("all").alias("group"), F.col("group").alias("name"), F.col("root").alias("leaf"))
    groups, whole = trees(subroots, ["name"], low)
    above = table_of(with_blocks(groups, whole), group_proof(low), GROUP_PROOFS).withColumnRenamed("root", "whole")
    tops = blocks.join(above, F.col("group").eqNullSafe(F.col("name"))).drop("name")
    id_type = docs.schema[id_col].dataType.simpleString()
    extra = ", proof array<array<string>>, places array<bigint>, levels int" if proofs else ""
    made = table_of(with_blocks(rows, tops), row_proof(proofs, low), f"id {id_type}, {ROW_PROOFS}{extra}")
    return made.withColumnRenamed("id", id_col)


def _sql_level(level: str, k: int) -> str:
    """DuckDB: the nodes of level k + 1 of all groups; a group with one node left keeps it."""
    return f"""
  {level}{k + 1} AS (SELECT g, i // 16 AS i, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h,
    count(*) OVER (PARTITION BY g) AS n FROM {level}{k} GROUP BY g, i // 16)"""


def _sql_fold(state: str, level: str, k: int) -> str:
    """DuckDB: what leaves fold to and their siblings so far, one level up."""
    return f"""
  {state}{k + 1} AS (SELECT rid, f.g, f.i // 16 AS i,
    CASE WHEN max(l.n) = 1 THEN max(fold) ELSE sha256(string_agg(CASE WHEN l.i = f.i THEN fold ELSE h END, '' ORDER BY l.i)) END AS fold,
    max(proof) || CASE WHEN max(l.n) = 1 THEN '' ELSE coalesce(string_agg(h, '' ORDER BY l.i) FILTER (l.i <> f.i), '') END AS proof
   FROM {state}{k} f JOIN {level}{k} l ON l.g IS NOT DISTINCT FROM f.g AND l.i // 16 = f.i // 16 GROUP BY rid, f.g, f.i)"""


def _sql_leaf(text: str) -> str:
    parts = [f"coalesce(octet_length(encode(v{c})) || ':' || v{c}, '-')" for c in range(len(FIELDS))]
    named = ", ".join(f"CAST({text if f == 'text' else f} AS VARCHAR) AS v{c}" for c, f in enumerate(FIELDS))
    return f"(SELECT sha256({' || '.join(parts)}) FROM (SELECT {named}))"


#: Levels that the check SQL can fold: 16 ** 6 rows a group and 16 ** 4 groups.
_DEEP, _HIGH = 6, 4
_SQL = f"""
 WITH d AS (SELECT row_number() OVER () AS rid, *, {_sql_leaf("text")} AS leaf,
   CASE WHEN doc_id IS NOT NULL AND {sql_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0
    THEN {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS found FROM documents),
  o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
  l0 AS (SELECT source AS g, i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM o),
  f0 AS (SELECT rid, source AS g, i, coalesce(found, leaf) AS fold, '' AS proof FROM o),
  {",".join(_sql_level("l", k) for k in range(_DEEP))}, {",".join(_sql_fold("f", "l", k) for k in range(_DEEP))},
  s0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n, g AS name FROM l{_DEEP}),
  t0 AS (SELECT rid, 0 AS g, s0.i, fold, proof FROM f{_DEEP} f JOIN s0 ON s0.name IS NOT DISTINCT FROM f.g),
  {",".join(_sql_level("s", k) for k in range(_HIGH))}, {",".join(_sql_fold("t", "s", k) for k in range(_HIGH))}
 SELECT doc_id, leaf, s0.h AS subroot, s{_HIGH}.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = s{_HIGH}.h AS verified
 FROM d JOIN t{_HIGH} USING (rid) JOIN s0 ON s0.name IS NOT DISTINCT FROM d.source, s{_HIGH}"""


@query("op11_merkle_manifest", _SQL)
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(*FIELDS)
    tampered = [lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(docs, found=F.when(hit, leaf_of(tampered)))
