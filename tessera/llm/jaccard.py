"""Similarity join of documents on word shingles: MinHash LSH forest, then exact Jaccard.

Documents with the same text are one vertex.  A vertex has, in each of ``TREES`` prefix tries, a
label of ``LEVELS`` bytes, one from each of as many minima of its shingles' hashes.  Labels are integers with the
first byte on top, so a trie is its labels in order and a node of depth d is a run of labels with d equal bytes.

The tries are read from the leaves up.  Pairs that share a whole label are verified first; then the matched prefixes are
shortened by a byte, and pairs that meet only now are verified, and so on.  A vertex stops
when the links it has found say that the target recall is reached: a link of similarity s is found at
depth d with probability p = 1 - (1 - s**d)**TREES, so it stands for (1 - p) / p links not found, and their sum over the
vertex's links must not pass the share that the target leaves.  So members of dense groups of near copies stop
deep in the tries, and no work is done on the wide nodes above them; a vertex with few links or none goes on to the
depth at which planted pairs exactly at the threshold meet with the target probability, as measured (:func:`floor_depth`).

A pair belongs to the first trie of those where it shares the longest prefix, so it is verified and counted
once.  A group of near copies is a node of nearly every trie.  Nodes of one depth that hold much the same vertices are united,
where the union has no more pairs than they have together: its vertices are sent once, not once per trie, and the
pairs that belong to one of its nodes are verified there.  Large nodes and units are dealt into blocks and verified a pair of
blocks at a time over bit maps of the shingles that two or more of their texts have.  Texts are read once, where a vertex shares a node at all; blocks get the sorted 64-bit hashes of its
shingles.  Rows that leave a block are one per vertex, never one per pair.

Defined cases: a null text is an empty one; a text of fewer than five words has one shingle, all its words,
so short texts match only when their words are the same, and empty texts match each other; a very long text is one
vertex with all its shingles; a null ``doc_id`` takes part
by its text and is never a class's name unless no other is there; rows with the same ``doc_id`` and
text are copies of each other, as are equal texts of different ids; an empty table gives no rows.  Other columns
are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.groups import block_pairs, local_roots, runs
from tessera.llm.idfilter import maybe_in
from tessera.llm.store import arrow_map, discard, materialize
from tessera.llm.words import Words, each_slice, mix, windows

SHINGLE = 5
THRESHOLD = 0.8
TREES = 24
LEVELS = 8
TARGET_RECALL = 0.9999
#: A block of a node holds about so many vertices at most, and about so many shingles.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Nodes of so many vertices are united with others where that saves rows.
LARGE = 64
#: One in so many vertices says which nodes are united.
SAMPLED = 8
#: Pairs whose shingles are compared at a time, as bits.
PAIRS = 1 << 14
#: Linked texts that a vertex must have before its own recall is estimated.
LEAST_LINKS = 64
_SHINGLE_BASE = 0xA0761D6478BD642F | 1


@lru_cache(maxsize=16)
def floor_depth(threshold: float = THRESHOLD, target: float = TARGET_RECALL, pairs: int = 2000, size: int = 90) -> int:
    """Longest prefix at which planted pairs of sets, exactly at the threshold, meet in some trie at the target rate.

    The rate at which a pair meets in one trie is measured over all pairs and tries.
    """
    common = round(2 * threshold * size / (1 + threshold))
    values = np.random.default_rng(8).integers(0, 1 << 64, (pairs, 2 * size - common), np.uint64)
    first = np.arange(pairs + 1) * size
    gap = labels(values[:, :size].ravel(), first) ^ labels(values[:, size - common :].ravel(), first)
    for depth in range(LEVELS, 1, -1):
        if 1 - (1 - _meet(gap, depth).mean()) ** TREES >= target:
            return depth
    return 1


def _meet(gap: np.ndarray, depth: int) -> np.ndarray:
    """Whether labels share ``depth`` bytes, from their exclusive or."""
    return gap < np.uint64(1 << 8 * (LEVELS - depth)) if depth else np.ones(gap.shape, bool)


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first hash of each document): every window of ``size`` words, or all words of a shorter text."""
    hashes, counts = words.hashes(), words.counts()
    many = np.maximum(counts - size + 1, 1)
    first = np.concatenate([[0], np.cumsum(many)])
    out = np.full(int(first[-1]), np.uint64(0x5851F42D4C957F2D))
    at = np.arange(first[-1]) - np.repeat(first[:-1] - words.first[:-1], many)
    full = np.repeat(counts >= size, many)
    if full.any():
        out[full] = windows(hashes, size, _SHINGLE_BASE, at[full])
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        short = hashes[words.first[d] : words.first[d + 1]]
        out[first[d]] = windows(short, len(short), _SHINGLE_BASE, np.zeros(1, np.int64))[0] + np.uint64(len(short))
    return out, first


def labels(values: np.ndarray, first: np.ndarray, trees: int = TREES, levels: int = LEVELS) -> np.ndarray:
    """Trie labels, documents by trees: the bytes of a label are hashes of minima, the first on top."""
    draw = np.random.default_rng(4)
    small = (values >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(first) - 1, trees), np.uint64)
    for t in range(trees):
        for k in range(levels):
            a, b = draw.integers(0, 1 << 32, 2, dtype=np.uint32)
            least = np.minimum.reduceat((small ^ b) * (a | np.uint32(1)), first[:-1])
            byte = mix(least.astype(np.uint64) + np.uint64((t * levels + k) << 32)) >> np.uint64(56)
            out[:, t] |= byte << np.uint64(8 * (levels - 1 - k))
    return out


def distinct_shingles(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Per document the bytes of its distinct shingle hashes in order."""
    sets = [np.unique(values[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return pa.array([x.tobytes() for x in sets], pa.binary())


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, size, labels) of every document; k1 and k2 are hashes of the text, size is its shingles."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in each_slice(batch.column(3)):
                values, first = shingles(words)
                found = labels(values, first)
                offsets = np.arange(0, found.size + 1, found.shape[1]).astype(np.int32)
                flat = pa.array(found.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo) for i in range(3)), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                    ["doc_id", "k1", "k2", "size", "labels"],
                )

    return arrow_map(_keyed(docs).select("doc_id", "k1", "k2", "text"), sign, "doc_id long, k1 long, k2 long, size long, labels array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"), text.alias("text"))


def overlaps(values: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sorted distinct arrays, where ``wanted``; 0 elsewhere."""
    n = len(values)
    out = np.zeros((n, n), np.int64)
    if wanted.sum() <= 4 * n:
        for a, b in np.argwhere(wanted):
            x, y = values[a], values[b]
            spot = np.searchsorted(x, y)
            out[a, b] = (x[np.minimum(spot, len(x) - 1)] == y).sum()
        return out
    sizes = np.fromiter(map(len, values), np.int64, n)
    owner = np.repeat(np.arange(n), sizes)
    _, column, held = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    shared = held[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total, step = int(column[-1]) + 1 if len(column) else 0, 4096
    first, second = np.nonzero(wanted)
    both = np.zeros(len(first), np.int64)
    for lo in range(0, total, step):
        a, b = np.searchsorted(column, (lo, lo + step))
        part = np.zeros((n, -(-min(step, total - lo) // 64) * 64), bool)
        part[owner[a:b], column[a:b] - lo] = True
        bits = np.packbits(part, axis=1).view(np.uint64)
        for at in range(0, len(first), PAIRS):
            some = slice(at, at + PAIRS)
            both[some] += np.bitwise_count(bits[first[some]] & bits[second[some]]).sum(axis=1, dtype=np.int64)
    out[first, second] = both
    return out


def new_pairs(found: np.ndarray, tree: int, depth: int, own: np.ndarray | None = None) -> np.ndarray:
    """Pairs whose longest common prefix over all tries is ``depth`` bytes and is had in ``tree`` first.

    For a unit, whose ``tree`` is ``TREES``, that first trie is one of those in which the vertex's node is the unit's: the bits of ``own``.
    """
    n, step = len(found), max(1, (1 << 20) // (max(len(found), 1) * TREES))
    out = np.zeros((n, n), bool)
    for lo in range(0, n, step):
        gap = found[lo : lo + step, None, :] ^ found[None, :, :]
        if tree < TREES:
            here = _meet(gap[:, :, tree], depth) & ~_meet(gap[:, :, :tree], depth).any(axis=2)
        else:
            meets = _meet(gap, depth)
            here = meets.any(axis=2) & (own[lo : lo + step, None] >> meets.argmax(axis=2) & 1).astype(bool)
        out[lo : lo + step] = here & ~_meet(gap, depth + 1).any(axis=2) if depth < LEVELS else here
    return out


def verify_block(vertex, weight, side, done, own, found, values, tree: int, lo: int, hi: int, depth: int, threshold: float):
    """(vertex, root, links, others, missing) of the vertices with a new link in one pair of blocks of a node of ``tree`` or of a unit.

    ``others`` are linked vertices, ``missing`` has for each depth how many more they stand for that are not found there.
    """
    n = len(vertex)
    wanted = np.triu(np.ones((n, n), bool), 1)
    if lo != hi:
        wanted &= side[:, None] != side[None, :]
    wanted &= ~(done[:, None] & done[None, :])
    sizes = np.fromiter(map(len, values), np.int64, n)
    wanted &= np.minimum(sizes[:, None], sizes[None, :]) >= threshold * np.maximum(sizes[:, None], sizes[None, :]) - 1e-9
    if wanted.any():
        wanted &= new_pairs(found, tree, depth, own)
    if not wanted.any():
        return None
    both = overlaps(values, wanted)
    union = sizes[:, None] + sizes[None, :] - both
    linked = wanted & (both >= threshold * union - 1e-9)
    a, b = np.nonzero(linked)
    similar = both[a, b] / union[a, b]
    missing = np.zeros((n, LEVELS))
    for k in range(LEVELS):
        p = 1 - (1 - similar ** (k + 1)) ** TREES
        missing[:, k] = np.bincount(a, (1 - p) / p, n) + np.bincount(b, (1 - p) / p, n)
    linked |= linked.T
    any_ = linked.any(axis=1)
    return vertex[any_], vertex[local_roots(linked)[any_]], (linked @ weight)[any_], linked.sum(axis=1)[any_], missing[any_]


_LINKS = "vertex long, root long, links long, others long, missing array<double>"


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k1, n, labels, hashes), one row for each of ``wanted`` (k1, rep, n, labels): the distinct shingle hashes of its text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in each_slice(batch.column(3)):
                same = [batch.column(i).slice(lo, hi - lo) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*same, distinct_shingles(*shingles(words))], ["k1", "n", "labels", "hashes"])

    texts = maybe_in(_keyed(docs).select(F.col("k1").alias("key"), "doc_id", "text"), wanted.select(F.col("k1").alias("key")), "key")
    rows = wanted.join(texts, wanted["rep"].eqNullSafe(texts["doc_id"]) & (wanted["k1"] == texts["key"])).select("k1", "n", "labels", "text")
    found = materialize(arrow_map(rows, find, "k1 long, n long, labels array<long>, hashes binary"), "shingle-sets")
    # Rows with one id and one text come several times.
    again = found.groupBy("k1").count().filter("count > 1").select("k1")
    if not again.take(1):
        return found
    return materialize(found.join(again, "k1", "left_anti").unionByName(found.join(again, "k1", "left_semi").dropDuplicates(["k1"])), "shingle-sets")


def _nodes(vertices: DataFrame, depth: int) -> DataFrame:
    """(tree, prefix, k1, size, done): the nodes of ``depth`` on the paths of each vertex."""
    below = vertices.select("k1", "size", "done", F.posexplode("labels").alias("tree", "label"))
    return below.select("tree", F.shiftrightunsigned("label", 8 * (LEVELS - depth)).alias("prefix"), "k1", "size", "done")


def _blocks(m: str, size: str, block: int) -> Column:
    """Blocks of a node or unit of ``m`` vertices with ``size`` shingles."""
    return F.least(F.greatest(F.ceil(F.col(m) / F.lit(float(block))), F.ceil(F.col(size) / F.lit(float(BLOCK_SHINGLES)))), F.col(m)).cast("int")


def _members(below: DataFrame, new: DataFrame, block: int) -> DataFrame:
    """(tree, prefix, k1, done, own, blocks): the members of the nodes ``new``, and of units of them in place of their nodes.

    A large node goes with the node that is the largest of most of its vertices, as a sample of them says.  Any choice is right, as a
    pair is verified where the first node that it shares is; a unit of more pairs than its nodes is not made.
    """
    columns = ["tree", "prefix", "k1", "done", "own", "blocks"]
    large = new.filter(F.col("m") >= LARGE).select("m", "tree", "prefix")
    if not large.take(2)[1:]:
        return below.join(new, ["tree", "prefix"]).withColumn("own", F.lit(0)).select(*columns)
    sample = below.filter(F.pmod(F.xxhash64(F.lit(9), "k1"), F.lit(SAMPLED)) == 0).select("tree", "prefix", "k1")
    # A vertex has one node in each trie, so its list is short.
    each = sample.join(large, ["tree", "prefix"]).groupBy("k1").agg(F.collect_list(F.struct("m", "tree", "prefix")).alias("nodes"))
    each = each.select(F.array_max("nodes").alias("hub"), F.explode("nodes").alias("node"))
    units = each.groupBy("node.tree", "node.prefix").agg(F.mode(F.xxhash64("hub.tree", "hub.prefix")).alias("unit"))
    nodes = materialize(new.join(units, ["tree", "prefix"], "left").select("tree", "prefix", "m", "blocks", "unit"), "trie-units")
    members = materialize(below.join(nodes.drop("m"), ["tree", "prefix"]), "members")
    bit = F.call_function("shiftleft", F.lit(1), F.col("tree"))
    united = members.filter("unit IS NOT NULL").groupBy("unit", "k1").agg(F.bit_or(bit).alias("own"), F.first("size").alias("size"), F.first("done").alias("done"))
    parts = nodes.filter("unit IS NOT NULL").groupBy("unit").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.col("m") * F.col("m")).alias("pairs"))
    worth = united.groupBy("unit").agg(F.count(F.lit(1)).alias("vertices"), F.sum("size").alias("shingles")).join(parts, "unit")
    worth = worth.filter("nodes > 1 AND vertices * vertices <= pairs")
    worth = materialize(worth.select("unit", _blocks("vertices", "shingles", block).alias("all")), "worth")
    whole = united.join(worth, "unit").select(F.lit(TREES).alias("tree"), F.col("unit").alias("prefix"), "k1", "done", "own", F.col("all").alias("blocks"))
    alone = members.join(worth, "unit", "left_anti").withColumn("own", F.lit(0)).select(*columns)
    return alone.unionByName(whole)


def verified_links(docs: DataFrame, classes: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(vertex, root, links, ...) by blocks, and (k1, depth) of the vertices that stopped above the floor of the forest."""
    spark, floor = docs.sparkSession, floor_depth(threshold, target)
    start = classes.select("k1", "rep", "n", "size", "labels", F.lit(False).alias("done"))
    below = _nodes(start, floor)
    shared = below.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("tree", "prefix")
    met = below.join(shared, ["tree", "prefix"]).select("k1").distinct()
    vertices = materialize(start.drop("done").join(met, "k1"), "met-vertices")
    sets = shingle_sets(docs, vertices.select("k1", "rep", "n", "labels"))
    stopped = spark.createDataFrame([], "k1 long, depth int")
    links = spark.createDataFrame([], _LINKS)
    seen = None
    for depth in range(LEVELS, floor - 1, -1):
        state = vertices.join(stopped, "k1", "left").withColumn("done", F.col("depth").isNotNull()).drop("depth")
        below = _nodes(state, depth)
        nodes = below.groupBy("tree", "prefix").agg(
            F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("k1")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(7), "k1")).alias("x2"), F.sum("size").alias("size"), F.bool_and("done").alias("done")
        )
        # Nodes that hold the same vertices in several tries are one; so are nodes that a shorter prefix adds nothing to.
        new = nodes.filter("m > 1 AND NOT done").groupBy("m", "x1", "x2", "size").agg(F.min(F.struct("tree", "prefix")).alias("node"))
        if seen is not None:
            new = new.join(seen, ["m", "x1", "x2"], "left_anti")
        new = materialize(new.select("m", "x1", "x2", _blocks("m", "size", block).alias("blocks"), "node.tree", "node.prefix"), "trie-nodes")
        if not new.take(1):
            continue
        dealt = block_pairs(_members(below, new, block), F.col("blocks"), F.xxhash64(F.lit(3), "k1"))
        rows = dealt.join(sets, "k1").select("tree", "prefix", "lo", "hi", "side", "done", "own", "k1", "n", "labels", "hashes")
        found = materialize(_verified(rows, depth, threshold), "links")
        links = links.unionByName(found)
        seen = new.select("m", "x1", "x2") if seen is None else seen.unionByName(new.select("m", "x1", "x2"))
        if depth > floor:
            sums = links.groupBy(F.col("vertex").alias("k1")).agg(F.sum("others").alias("others"), F.sum(F.col("missing")[depth - 1]).alias("missing"))
            enough = sums.filter((F.col("others") >= LEAST_LINKS) & (F.col("missing") <= F.col("others") * F.lit(1 - target)))
            fresh = enough.join(stopped, "k1", "left_anti").select("k1", F.lit(depth).alias("depth"))
            stopped = stopped.unionByName(materialize(fresh, "stopped"))
    return links, stopped


def _verified(rows: DataFrame, depth: int, threshold: float) -> DataFrame:
    """Links of the pairs of blocks in ``rows`` that are new at ``depth``."""
    keys = ["tree", "prefix", "lo", "hi"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, keys):
            if group.num_rows < 2:
                continue
            tree, lo, hi = (int(group[k][0].as_py()) for k in ("tree", "lo", "hi"))
            columns = [group[k].to_numpy() for k in ("k1", "n", "side", "done", "own")]
            found = group["labels"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, TREES)
            values = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["hashes"]]
            out = verify_block(*columns, found, values, tree, lo, hi, depth, threshold)
            if out is not None:
                ends = np.arange(0, out[4].size + 1, LEVELS).astype(np.int32)
                missing = pa.ListArray.from_arrays(pa.array(ends), pa.array(out[4].ravel()))
                yield pa.RecordBatch.from_arrays([*map(pa.array, out[:4]), missing], ["vertex", "root", "links", "others", "missing"])

    return arrow_map(rows.repartition(*keys).sortWithinPartitions(*keys), verify, _LINKS)


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """(doc_id, k1, k2, class_id, component, n_links, depth) of every row of ``docs`` (doc_id, text).

    ``class_id`` is the least ``doc_id`` of the documents connected by links, ``component`` the same
    group's internal name, ``depth`` the shortest prefix that was matched for the text.
    """
    signed = materialize(signatures(docs), "signatures")
    classes = materialize(
        signed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("labels").alias("labels")), "text-classes"
    )
    links, stopped = verified_links(docs, classes, threshold, target)
    joined = components(links.select(F.col("vertex").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy(F.col("vertex").alias("k1")).agg(F.sum("links").alias("links"))
    placed = classes.select("k1", "k2", "n", "rep").join(counts, "k1", "left").join(joined.withColumnRenamed("vertex", "k1"), "k1", "left").join(stopped, "k1", "left")
    n_links, depth = F.col("n") - 1 + F.coalesce("links", F.lit(0)), F.coalesce("depth", F.lit(floor_depth(threshold, target)))
    placed = materialize(placed.select("k1", "k2", "rep", F.coalesce("component", "k1").alias("component"), n_links.alias("n_links"), depth.alias("depth")), "placed")
    names = placed.groupBy("component").agg(F.min("rep").alias("class_id"))
    named = materialize(placed.join(names, "component").select("k1", "k2", "component", "class_id", "n_links", "depth"), "named")
    discard(placed)
    return signed.select("doc_id", "k1", "k2").join(named, ["k1", "k2"])


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class and its number of links."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_groups(docs).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates: the one with the least ``doc_id``. All columns stay."""
    found = near_groups(docs.select("doc_id", "text"))
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("doc_id", "component").agg(
        F.min(F.struct("k1", "k2")).alias("key"), F.count(F.lit(1)).alias("copies")
    )
    kept = materialize(kept.select(F.col("doc_id").alias("kept_id"), "key.k1", "key.k2", "component", "copies"), "kept")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"),
    )
    rows = rows.join(kept, rows["id"].eqNullSafe(kept["kept_id"]) & (rows["a"] == kept["k1"]) & (rows["b"] == kept["k2"]))
    # Rows of one id and one text: only these need to meet, and they are few.
    again = rows.filter("copies > 1").groupBy("id", "component").agg(F.first("row").alias("row"))
    return rows.filter("copies = 1").select("row.*").unionByName(again.select("row.*"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one(docs)


ORACLE_SQL = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') AS ws FROM documents),
spots AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 1}, 1) + 1)) AS p FROM split),
sets AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + {SHINGLE - 1}], ' ') AS s FROM spots),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
meets AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM meets JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE c >= {THRESHOLD} * (x.n + y.n - c) - 1e-9),
reach AS (SELECT doc_id, doc_id AS root FROM sizes UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id),
named AS (SELECT doc_id, min(root) AS class_id FROM reach GROUP BY doc_id)
SELECT n.doc_id, class_id, (SELECT count(*) FROM links WHERE a = n.doc_id) AS n_links FROM named n
"""
