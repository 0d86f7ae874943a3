"""SimHash near-dedup with BK-trees.

Fingerprints are the majority bits of the shingle hashes. Rows with equal fingerprints
fall together first; the distinct ones are searched for links.

Search. Two fingerprints at most `radius` bits apart agree on at least `blocks - radius`
of `blocks` blocks of bits, so every link is seen by a bucket of fingerprints that agree
on some choice of that many blocks: none is lost. A bucket holds a BK-tree, in which a
child is keyed by its integer Hamming distance to the parent; a query follows only edges
whose key lies within the radius of its own distance to the node. A large bucket is cut
into shards of at most SHARD fingerprints, and each shard's tree is sent to every slice
of the bucket's queries, so that no task holds more than two shards. A search gives each
fingerprint one link to the head of its linked group in the bucket, not all pairs; the
groups are joined up by connected components over written link tables.

Trees of many buckets are built and searched together, one level at a time, with numpy.

Defined cases: null and blank texts have fingerprint zero and link like any other;
repeated rows fall together; a null id takes part in links but cannot name a group (a
group of null ids only has a null component); an empty table gives an empty result;
extra columns are left out of the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import small_table
from .bloom import Bloom
from .common import batch_of, query, row_key, saved, small_batches, table
from .components import components

SEED = 42
SHARD = 8192
#: Pairs of a query and a node that a search may reach at once: some 200 bytes each.
CHUNK = 1 << 17
BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every shingle of lower-cased words; the whole text's if it has fewer words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, "<u8")
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], "<u8")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    spans = zip((ends - lengths)[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), "<u8", len(words) - size + 1)


def mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Other 64-bit hashes of the same shingles, for further words of a wide fingerprint."""
    if not word:
        return hashes
    h = hashes ^ np.uint64((0x9E3779B97F4A7C15 * word) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint: bits set in over half the hashes; none: zero."""
    count = np.zeros((8, 8), np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536]
        slots = part.view(np.uint8).reshape(-1, 8) + np.arange(8, dtype=np.uint16) * 256
        count += np.bincount(slots.ravel(), minlength=2048).reshape(8, 256) @ BITS_OF_BYTE
    bits = (2 * count > len(hashes)).ravel().astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = [majority_bits(shingle_hashes(t, size)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, fp bigint")


def block_masks(blocks: int, radius: int) -> list[int]:
    """A mask of 64 bits for every choice of blocks - radius blocks."""
    if not radius < blocks <= 64:
        raise ValueError("more blocks than differing bits are needed")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(choice) for choice in combinations(masks, blocks - radius)]


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints given as rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def build_trees(values: np.ndarray, heads: np.ndarray) -> dict[str, np.ndarray]:
    """BK-trees of many groups at once: heads[i] is the index of the root of item i's tree.

    Items descend level by level; of the items that reach a node by edges of equal
    distance the first becomes the child there. Children of a node are stored together.
    """
    n = len(values)
    parent, key = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    item = np.flatnonzero(heads != np.arange(n))
    node = heads[item]
    while len(item):
        gap = bits_apart(values[item], values[node])
        order = np.lexsort((item, gap, node))
        item, node, gap = item[order], node[order], gap[order]
        first = np.ones(len(item), bool)
        first[1:] = (node[1:] != node[:-1]) | (gap[1:] != gap[:-1])
        parent[item[first]], key[item[first]] = node[first], gap[first]
        child = item[np.maximum.accumulate(np.where(first, np.arange(len(item)), 0))]
        item, node = item[~first], child[~first]
    kids = np.flatnonzero(parent >= 0)
    kids = kids[np.lexsort((key[kids], parent[kids]))]
    low = np.searchsorted(parent[kids], np.arange(n), "left")
    high = np.searchsorted(parent[kids], np.arange(n), "right")
    return {"kids": kids, "key": key, "low": low, "high": high}


def search_trees(values: np.ndarray, tree: dict[str, np.ndarray], query: np.ndarray, root: np.ndarray,
                 radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, item) index pairs at most radius bits apart, in the trees under root."""
    found_q, found_i = [], []
    while len(query):
        gap = bits_apart(values[query], values[root])
        near = gap <= radius
        found_q.append(query[near])
        found_i.append(root[near])
        low, many = tree["low"][root], tree["high"][root] - tree["low"][root]
        start = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many)
        kid = tree["kids"][start + np.arange(len(start))]
        follow = np.abs(tree["key"][kid] - np.repeat(gap, many)) <= radius
        query, root = np.repeat(query, many)[follow], kid[follow]
    return np.concatenate(found_q or [query]), np.concatenate(found_i or [query])


def lowest_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the groups of a[i] and b[i]: each item's lowest linked index."""
    while True:
        la, lb = label[a], label[b]
        low, differ = np.minimum(la, lb), la != lb
        if not differ.any():
            return label
        np.minimum.at(label, la[differ], low[differ])
        np.minimum.at(label, lb[differ], low[differ])
        while (step := label[label] != label).any():
            label[step] = label[label[step]]
        a, b = a[differ], b[differ]


def found_pairs(values: np.ndarray, bucket: np.ndarray, in_tree: np.ndarray, asks: np.ndarray,
                radius: int, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, item) index pairs within the radius, some queries at a time; bucket must be sorted.

    in_tree: the item is part of its bucket's tree; asks: it is a query to that tree.
    """
    n = len(values)
    if not n:
        return
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
    members = np.flatnonzero(in_tree)
    roots = np.full(len(starts), -1, np.int64)
    roots[group[members][::-1]] = members[::-1]
    local = np.full(n, -1, np.int64)
    local[members] = np.arange(len(members))
    tree = build_trees(values[members], local[roots[group[members]]])
    if len(members) < n:  # indices of members become indices of items
        spread = {k: np.zeros(n, np.int64) for k in ("key", "low", "high")}
        for k in spread:
            spread[k][members] = tree[k]
        tree = {**spread, "kids": members[tree["kids"]]}
    queries = np.flatnonzero(asks & (roots[group] >= 0))
    sizes = np.bincount(group, minlength=len(starts))[group[queries]]
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(chunk, int(sizes.sum()) + chunk, chunk), "right")
    at = 0
    for end in cuts:  # bounded work: about `chunk` (query, node) pairs at most at a time
        end = max(int(end), at + 1)
        part = queries[at:end]
        if len(part):
            yield search_trees(values, tree, part, roots[group[part]], radius)
        at = end


def link_buckets(values: np.ndarray, bucket: np.ndarray, in_tree: np.ndarray, asks: np.ndarray,
                 radius: int, chunk: int = CHUNK) -> np.ndarray:
    """The lowest linked index of every item."""
    label = np.arange(len(values))
    for q, i in found_pairs(values, bucket, in_tree, asks, radius, chunk):
        label = lowest_labels(label, q, i)
    return label


def pair_buckets(values: np.ndarray, bucket: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, radius: int,
                 most: int, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs (item, lower item) within the radius: the `most` lowest of every query, and whether there were more.

    A pair that both its items find counts for the later one only.
    """
    later, lower, more = [np.empty(0, np.int64)], [np.empty(0, np.int64)], False
    for q, i in found_pairs(values, bucket, in_tree, asks, radius, chunk):
        once = (i < q) | ~(in_tree[q] & asks[i])
        order = np.lexsort((i[once], q[once]))
        q, i = q[once][order], i[once][order]
        near = np.arange(len(q)) - np.searchsorted(q, q, "left") < most
        more |= not near.all()
        later.append(np.maximum(q, i)[near])
        lower.append(np.minimum(q, i)[near])
    return np.concatenate(later), np.concatenate(lower), more


def bucket_links(rows: DataFrame, radius: int, most: int | None = None) -> DataFrame:
    """(u, v) links of nodes. rows: (place, part, node, in_tree, asks, fp...); a bucket is (place, part).

    With `most` links are pairs within the radius, as many for each node of a bucket; a
    row of nulls tells that some bucket held more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_buckets(batches):
            place, node, in_tree, asks, *words = columns
            values = np.stack(words, axis=1).view(np.uint64)
            if most:
                later, lower, more = pair_buckets(values, place, in_tree, asks, radius, most)
                if more:
                    yield batch_of({"u": ([None], pa.int64()), "v": ([None], pa.int64())})
            else:
                label = link_buckets(values, place, in_tree, asks, radius)
                later = np.flatnonzero(label != np.arange(len(label)))
                lower = label[later]
            yield batch_of({"u": (node[later], pa.int64()), "v": (node[lower], pa.int64())})

    spread = rows.repartition("place", "part").sortWithinPartitions("place", "part", "node")
    return spread.mapInArrow(run, "u bigint, v bigint").distinct()


def whole_buckets(batches: Iterator[pa.RecordBatch], least: int = 1 << 17) -> Iterator[tuple]:
    """Runs of whole buckets of about `least` rows, without buckets of one row.

    Gives (bucket number, *other columns) of rows sorted by bucket, that is by the first two columns.
    """
    def arrays(batch):
        return [c.to_numpy(zero_copy_only=False) for c in batch.columns]

    def numbered(held):
        place, part, *rest = (np.concatenate(x) for x in zip(*held))
        if not len(place):
            return None
        new = np.r_[True, (place[1:] != place[:-1]) | (part[1:] != part[:-1])]
        bucket = np.cumsum(new) - 1
        many = np.bincount(bucket)[bucket] > 1
        return (bucket[many], *(x[many] for x in rest)) if many.any() else None

    held, rows = [], 0
    for batch in batches:
        got = arrays(batch)
        if not batch.num_rows:
            continue
        if rows >= least:  # all up to the last bucket change of this batch is whole
            change = np.flatnonzero((got[0][1:] != got[0][:-1]) | (got[1][1:] != got[1][:-1]))
            if (held[-1][0][-1], held[-1][1][-1]) != (got[0][0], got[1][0]):
                cut = 0
            elif len(change):
                cut = int(change[0]) + 1
            else:
                cut = None
            if cut is not None:
                if (ready := numbered([*held, [x[:cut] for x in got]])) is not None:
                    yield ready
                held, rows, got = [], 0, [x[cut:] for x in got]
        held.append(got)
        rows += len(got[0])
    if held and (ready := numbered(held)) is not None:
        yield ready


def near_links(fps: DataFrame, routes: Callable[[DataFrame], DataFrame], radius: int,
               shard: int = SHARD, most: int | None = None) -> DataFrame:
    """Links (u, v) between the nodes of fps (node, fp...) that meet in a bucket.

    routes(fps) gives one row (place, node, fp...) per bucket of a node. most: see bucket_links.
    """
    routed = routes(fps)
    words = [c for c in routed.columns if c.startswith("fp")]
    large = routed.groupBy("place").count().where(F.col("count") > shard).select(
        "place", F.ceil(F.col("count") / shard).cast("int").alias("shards"))
    large, _ = saved(large, "large-buckets")
    shards = F.coalesce("shards", F.lit(1))
    own = F.pmod(F.xxhash64("node", "place"), shards).cast("int")
    # Pairs (i, j) of shards with i <= j: i's tree meets j's queries. A row of shard h is
    # in the tree of the pairs (h, *) and asks in the pairs (*, h).
    met = routed.join(large, "place", "left").withColumn("shards", shards).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    rows = met.select(
        "place", (low * F.col("shards") + high).alias("part"), "node",
        (F.col("own") == low).alias("in_tree"), (F.col("own") == high).alias("asks"), *words)
    return bucket_links(rows, radius, most)


def agreeing_blocks(blocks: int, radius: int) -> Callable[[DataFrame], DataFrame]:
    """Routes by every choice of blocks that fingerprints within the radius can agree on."""
    masks = block_masks(blocks, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]

    def routes(fps: DataFrame) -> DataFrame:
        places = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
        return fps.select(F.explode(places).alias("place"), "node", "fp")

    return routes


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4,
                   blocks: int = 6) -> DataFrame:
    """(id, fingerprint, component_id) of every row: 16 hexadecimal digits and the smallest id reachable."""
    rows, _ = saved(fingerprints(docs, id_col, text_col, size), "fingerprints")
    distinct, _ = saved(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    # A fingerprint is its own node number.
    links = near_links(distinct.select(F.col("fp").alias("node"), "fp"), agreeing_blocks(blocks, radius), radius)
    joined = components(links)
    linked = distinct.join(joined, distinct["fp"] == joined["node"]).select("fp", "first", "component")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    named = linked.join(least, "component").select(F.col("fp").alias("linked_fp"), "least")
    ids = distinct.join(named, distinct["fp"] == named["linked_fp"], "left").select(
        F.col("fp").alias("own_fp"), F.coalesce("least", "first").alias("component_id"))
    return rows.join(ids, rows["fp"] == ids["own_fp"]).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def set_hash(hashes: np.ndarray) -> int:
    """Signed hash of a set of shingle hashes, given in ascending order."""
    value = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
    return value - (1 << 64) if value >> 63 else value


def wide_fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int, words: int, bands: int,
                      band_bits: int) -> DataFrame:
    """(id, row, node, fp0.., places): a shingle set's hash, its fingerprint of 64 * words bits, and its buckets.

    The fingerprint is that of the shingles; buckets come from bands of bits of another
    one, over the text's different words, which near copies share far more fully.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    route_words = -(-bands * band_bits // 64)
    names = [f"fp{i}" for i in range(words)]

    def places(text: str | None) -> list[int]:
        hashes = np.unique(shingle_hashes(text, 1))
        bits = sum(majority_bits(mixed(hashes, i + 1)) << 64 * i for i in range(route_words))
        mask = (1 << band_bits) - 1
        return [b << band_bits | (bits >> b * band_bits & mask) for b in range(bands)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column(2).to_pylist()
            hashes = [np.unique(shingle_hashes(t, size)) for t in texts]
            fps = np.array([[majority_bits(mixed(h, i)) for i in range(words)] for h in hashes], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([set_hash(h) for h in hashes], pa.int64()),
                 *(pa.array(fps[:, i]) for i in range(words)), pa.array([places(t) for t in texts], pa.list_(pa.int64()))],
                names=["id", "row", "node", *names, "places"])

    schema = f"id {kind}, row bigint, node bigint, {', '.join(f'{n} bigint' for n in names)}, places array<bigint>"
    return docs.select(id_col, row_key(id_col, text_col), text_col).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, size: int, rows: Bloom) -> DataFrame:
    """(node, shingles) of the rows whose key may be among those: the shingle hashes of the text, and the hash of the set.

    The filter is asked by the task that hashes, as one that is a column would need a
    second Python worker beside it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1024):
            texts = batch.column(1).filter(pa.array(rows.has(batch.column(0).to_numpy()))).to_pylist()
            hashes = [np.unique(shingle_hashes(t, size)) for t in texts]
            yield batch_of({
                "node": ([set_hash(h) for h in hashes], pa.int64()),
                "shingles": ([h.view(np.int64) for h in hashes], pa.list_(pa.int64()))})

    return docs.select(row_key(id_col, text_col), text_col).mapInArrow(run, "node bigint, shingles array<bigint>")


def similar_pairs(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int,
                  similarity: float) -> DataFrame:
    """The pairs (u, v) of nodes whose shingle sets have that Jaccard similarity, counted exactly.

    Only the texts of the pairs' nodes, and the few others a Bloom filter lets pass, are read into sets.
    """
    asked = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    texts = Bloom(nodes.join(asked, "node").select(F.col("first.row").alias("row")), "row")
    sets, _ = saved(shingle_sets(docs, id_col, text_col, size, texts).dropDuplicates(["node"]), "shingle-sets")
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    return pairs.join(left, "u").join(right, "v").where(
        shared >= similarity * (F.size("a") + F.size("b") - shared) - 1e-9).select("u", "v")


def radius_of(jaccard: float, bits: int) -> int:
    """Bits that differ, on average, between fingerprints of shingle sets of that similarity."""
    return round(bits * math.acos(2 * jaccard / (1 + jaccard)) / math.pi)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                     similarity: float = 0.8, slack: int = 16, words: int = 4, bands: int = 42,
                     band_bits: int = 18, most: int = 2) -> DataFrame:
    """docs without near copies: of every group of them the document of the smallest id stays.

    Near copies are linked if the sets of their shingles have at least that Jaccard
    similarity, which is counted exactly. Candidates are pairs whose fingerprints of
    64 * words bits differ in no more bits than such sets' do on average, plus slack, and
    that agree on one of `bands` bands of `band_bits` bits. A round verifies up to `most`
    candidates of a document in a bucket and lets the copies go; rounds over those that
    stay, with four times as many candidates each, go on until none is left out.

    Of repeated rows one stays; rows with a null id stay only if their whole group has
    none. Texts with no word are copies of each other. Other columns pass through, whatever
    their names, but for `__row`.
    """
    rows, _ = saved(wide_fingerprints(docs, id_col, text_col, size, words, bands, band_bits), "fingerprints")
    fps = [c for c in rows.columns if c.startswith("fp")]
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    nodes, _ = saved(rows.groupBy("node").agg(
        first.alias("first"), F.count("*").alias("n"), F.any_value("places").alias("places"),
        *[F.any_value(c).alias(c) for c in fps]), "distinct-sets")
    staying, gone_nodes = nodes, None
    while True:
        found, _ = saved(near_links(
            staying, lambda f: f.select(F.explode("places").alias("place"), "node", *fps),
            radius_of(similarity, 64 * words) + slack, most=most), "candidates")
        more = not found.where("u IS NULL").isEmpty()
        links, _ = saved(similar_pairs(
            found.where("u IS NOT NULL"), nodes, docs, id_col, text_col, size, similarity), "verified")
        if links.isEmpty() and not more:
            break
        linked = nodes.select("node", "first").join(components(links), "node")
        best = linked.groupBy("component").agg(F.min("first").alias("best"))
        lost, _ = saved(linked.join(best, "component").where("first <> best").select("node"), "copies")
        gone_nodes = lost if gone_nodes is None else gone_nodes.union(lost)
        staying, _ = saved(staying.join(lost, "node", "left_anti"), "staying")
        most *= 4
    # Every row that is not the first of its node, and all rows of nodes that lost to another.
    placed = rows.select("id", "row", "node").join(nodes.select("node", "first", "n"), "node")
    if gone_nodes is not None:
        placed = placed.join(gone_nodes.withColumn("gone", F.lit(True)), "node", "left")
    else:
        placed = placed.withColumn("gone", F.lit(None).cast("boolean"))
    stays = F.col("gone").isNull() & (F.col("row") == F.col("first.row")) & F.col("id").eqNullSafe(F.col("first.id"))
    gone = small_table(placed.where(~stays).select(F.col("id").alias("__id"), F.col("row").alias("__at")).distinct(), "copies")
    keyed = docs.withColumn("__row", row_key(id_col, text_col))
    kept = keyed.join(gone, keyed[id_col].eqNullSafe(gone["__id"]) & (keyed["__row"] == gone["__at"]), "left_anti")
    # Rows repeated in id and text: all of them are the first of their node, one stays.
    again, _ = saved(
        placed.where(stays & (F.col("n") > 1)).groupBy(F.col("id").alias("__id"), F.col("row").alias("__at")).count()
        .where("count > 1").select("__id", "__at"), "repeated-rows")
    same = kept[id_col].eqNullSafe(again["__id"]) & (kept["__row"] == again["__at"])
    once = kept.join(again, same, "left_anti").select(*docs.columns)
    if again.isEmpty():
        return once
    return once.union(kept.join(again, same, "left_semi").dropDuplicates([id_col, "__row"]).select(*docs.columns))


@query("op1_simhash_near_dedup")
def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_groups(table(spark, folder, "documents").select("doc_id", "text"))
