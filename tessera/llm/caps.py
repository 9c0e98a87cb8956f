"""Near-duplicate vectors by spherical-cap filters from a random product code.

Filter directions are all combinations of one code word per block of coordinates.  A vector is list-decoded
to every filter whose direction it exceeds the cap's height on: block by block, dropping prefixes that
even the best remaining code words cannot lift over the height.  Its best filter is always among them.
Vectors that share a filter are compared in double precision, in blocks, and a pair is counted
at the least filter that both have.

Height and number of filters follow from the number of vectors (:func:`cap_plan`), so that a filter
holds some tens of unrelated vectors.  How often a pair at the threshold shares a filter of one such code is
measured on random pairs, and as many independent codes are used as the target recall takes.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component link with nothing
and are components of their own; vectors of different length do not link; equal vectors are
found without filters and each other's links; rows with the same ``vec_id`` count as different vectors;
a null ``vec_id`` is named by the others of its component; very long vectors are compared whole; an empty table gives no rows;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.groups import block_pairs, local_roots, runs
from tessera.llm.store import arrow_map, materialize

THRESHOLD = 0.95
PER_FILTER = 64
MEAN_SHARED = 12.0
TARGET_RECALL = 0.998
MOST_WORDS = 128
BLOCK = 512


@dataclass(frozen=True)
class CapPlan:
    """``height`` in units of 1/sqrt(dimension); ``codes`` independent codes of ``blocks`` books of ``words`` words each."""

    height: float
    blocks: int
    words: int
    codes: int = 1


def _upper(t: float) -> float:
    return 0.5 * math.erfc(t / math.sqrt(2))


@lru_cache(maxsize=64)
def cap_plan(n: int, dim: int, threshold: float = THRESHOLD, per_filter: int = PER_FILTER, shared: float = MEAN_SHARED, target: float = TARGET_RECALL) -> CapPlan:
    """Caps for ``n`` vectors, from the normal approximation of a coordinate on the sphere, and codes for the recall."""
    share = min(0.02, per_filter / max(n, 1))
    lo, hi = 0.0, 8.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _upper(mid) > share else (lo, mid)
    t = lo
    # Probability that the other vector of a pair at the threshold is above the height too.
    x = np.linspace(t, t + 6, 2001)
    density = np.exp(-x * x / 2)
    rest = math.sqrt(1 - threshold**2)
    both = float((density * [_upper((t - threshold * v) / rest) for v in x]).sum() / density.sum())
    filters = shared / (share * both)
    blocks = 2
    while filters ** (1 / blocks) > MOST_WORDS:
        blocks += 1
    plan = CapPlan(t, blocks, max(2, math.ceil(filters ** (1 / blocks))))
    if dim < 2:
        return plan
    # Random pairs exactly at the threshold: how many share a filter of one code?
    draw = np.random.default_rng(dim)
    one, side = draw.normal(size=(2, 1000, dim))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    side -= (side * one).sum(axis=1, keepdims=True) * one
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    found = [set(zip(*map(np.ndarray.tolist, decode(x, plan)), strict=True)) for x in (one, threshold * one + rest * side)]
    rate = len({row for row, _ in found[0] & found[1]}) / 1000
    return replace(plan, codes=1 if rate >= target else math.ceil(math.log(1 - target) / math.log(1 - max(rate, 0.01))))


@lru_cache(maxsize=64)
def code_books(dim: int, blocks: int, words: int, code: int = 0) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """(rotation, code books): random unit words for each block of the rotated coordinates."""
    draw = np.random.default_rng([dim, blocks, code])
    rotation, _ = np.linalg.qr(draw.normal(size=(dim, dim)))
    books = []
    for part in np.array_split(np.arange(dim), min(blocks, dim)):
        book = draw.normal(size=(words, len(part)))
        books.append(book / np.linalg.norm(book, axis=1, keepdims=True) * math.sqrt(len(part) / dim))
    return rotation, tuple(books)


def decode(unit: np.ndarray, plan: CapPlan) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every filter that each unit vector exceeds the height on, and of each code's best one."""
    found = [_decode_one(unit, plan, code) for code in range(plan.codes)]
    pairs = np.unique(np.concatenate([np.stack([row, filter_ + code * plan.words**plan.blocks], axis=1) for code, (row, filter_) in enumerate(found)]), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _decode_one(unit: np.ndarray, plan: CapPlan, code: int) -> tuple[np.ndarray, np.ndarray]:
    dim = unit.shape[1]
    rotation, books = code_books(dim, plan.blocks, plan.words, code)
    turned = unit @ rotation
    edges = np.cumsum([0, *(b.shape[1] for b in books)])
    scores = [turned[:, a:b] @ book.T for a, b, book in zip(edges[:-1], edges[1:], books, strict=True)]
    need = np.full(len(unit), plan.height / math.sqrt(dim))
    best = [s.max(axis=1) for s in scores]
    top = np.zeros(len(unit), np.int64)
    for s in scores:
        top = top * plan.words + s.argmax(axis=1)
    row, word_of, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
    for i, s in enumerate(scores):
        rest = sum(best[i + 1 :], np.zeros(len(unit)))
        sums = total[:, None] + s[row]
        k, word = np.nonzero(sums >= (need - rest)[row][:, None])
        row, word_of, total = row[k], word_of[k] * plan.words + word, sums[k, word]
    return np.concatenate([row, np.arange(len(unit))]), np.concatenate([word_of, top])


def _rows(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = lists.offsets.to_numpy()
    return offsets, lists.values.to_numpy(zero_copy_only=False).astype(np.float64)


def filters_of(classes: DataFrame, n: int, threshold: float = THRESHOLD) -> DataFrame:
    """(k1, n, embedding, caps): the filters of each distinct vector, in ascending order."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, flat = _rows(batch.column(2))
            sizes = np.diff(offsets)
            lists: list = [None] * len(sizes)
            for dim in np.unique(sizes):
                for at in np.array_split(np.flatnonzero(sizes == dim), max(1, int((sizes == dim).sum()) // 1024)):
                    vectors = flat[offsets[at][:, None] + np.arange(dim)[None, :]]
                    # Scaled first, so that neither tiny nor huge components lose their squares.
                    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
                    row, caps = decode(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), cap_plan(n, int(dim), threshold))
                    for i, part in zip(at, np.split(caps, np.searchsorted(row, np.arange(1, len(at)))), strict=True):
                        lists[i] = part
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            caps = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, caps], ["k1", "n", "embedding", "caps"])

    return arrow_map(classes.select("k1", "n", "embedding"), find, "k1 long, n long, embedding array<double>, caps array<long>")


def verify_block(vertex, weight, side, vectors, caps: list[np.ndarray], cap: int, lo: int, hi: int, threshold: float):
    """(vertex, root, links) of the vectors with a link in one pair of blocks of a filter."""
    n = len(vertex)
    wanted = np.triu(np.ones((n, n), bool), 1)
    if lo != hi:
        wanted &= side[:, None] != side[None, :]
    before = [c[: np.searchsorted(c, cap)] for c in caps]
    owner = np.repeat(np.arange(n), [len(c) for c in before])
    if len(owner):  # a pair that shares a lesser filter belongs there
        _, column = np.unique(np.concatenate(before), return_inverse=True)
        held = np.zeros((n, int(column.max()) + 1), np.float32)
        held[owner, column] = 1
        wanted &= (held @ held.T) == 0
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    size = np.sqrt((vectors * vectors).sum(axis=1))
    linked = wanted & ((vectors @ vectors.T) / (size[:, None] * size[None, :]) >= threshold)
    linked |= linked.T
    any_ = linked.any(axis=1)
    if not any_.any():
        return None
    return vertex[any_], vertex[local_roots(linked)[any_]], (linked @ weight)[any_]


def verified_links(filtered: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(vertex, root, links) by blocks of the filters that two or more vectors share."""
    below = filtered.select("k1", F.size("embedding").alias("dim"), F.explode("caps").alias("cap"))
    nodes = below.groupBy("dim", "cap").agg(
        F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("k1")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(7), "k1")).alias("x2")
    )
    shared = nodes.filter("m > 1").groupBy("dim", "m", "x1", "x2").agg(F.min("cap").alias("cap")).select("dim", "cap", "m")
    shared = materialize(shared, "cap-nodes")
    dealt = block_pairs(below.join(shared, ["dim", "cap"]), F.ceil(F.col("m") / F.lit(float(block))), F.xxhash64(F.lit(3), "k1"))
    rows = dealt.join(filtered, "k1").select("dim", "cap", "lo", "hi", "side", "k1", "n", "embedding", "caps")
    keys = ["dim", "cap", "lo", "hi"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, keys):
            if group.num_rows < 2:
                continue
            group = group.combine_chunks()
            dim, cap, lo, hi = (int(group[k][0].as_py()) for k in keys)
            vectors = group["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            caps = [np.asarray(c) for c in group["caps"].to_pylist()]
            found = verify_block(group["k1"].to_numpy(), group["n"].to_numpy(), group["side"].to_numpy(), vectors, caps, cap, lo, hi, threshold)
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["vertex", "root", "links"])

    placed = rows.repartition(*keys).sortWithinPartitions(*keys)
    return arrow_map(placed, verify, "vertex long, root long, links long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding)."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.coalesce((F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("k1", F.when(good, F.xxhash64("embedding"))).withColumn("k2", F.when(good, F.xxhash64(F.lit("second"), "embedding")))
    classes = rows.filter("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("rep"), F.first("embedding").alias("embedding"))
    classes = materialize(classes, "vector-classes")
    filtered = materialize(filters_of(classes, classes.count(), threshold), "vector-caps")
    links = materialize(verified_links(filtered, threshold), "vector-links")
    joined = components(links.select(F.col("vertex").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy(F.col("vertex").alias("k1")).agg(F.sum("links").alias("links"))
    placed = classes.select("k1", "k2", "n", "rep").join(counts, "k1", "left").join(joined.withColumnRenamed("vertex", "k1"), "k1", "left")
    placed = materialize(placed.select("k1", "k2", "rep", F.coalesce("component", "k1").alias("component"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "placed-vectors")
    names = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = materialize(placed.join(names, "component").select("k1", "k2", "component_id", "n_links"), "named-vectors")
    ids = rows.select("vec_id", "k1", "k2")
    linked = ids.filter("k1 IS NOT NULL").join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = ids.filter("k1 IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_vector_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` at a cosine of 0.95 or more."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE_SQL = f"""
WITH RECURSIVE vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
reach AS (SELECT vec_id, vec_id AS root FROM vectors UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.vec_id),
named AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = n.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM named n
"""
