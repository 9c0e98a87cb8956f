"""Groups of rows inside sorted Arrow batches, for operators that look at one small block at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_pairs(members: DataFrame, blocks: Column, salt: Column) -> DataFrame:
    """One row of ``members`` for each pair of blocks that its block meets.

    A node is dealt to ``blocks`` blocks by ``salt``; every two rows of a node meet in exactly one
    (``lo``, ``hi``) pair of blocks, where ``side`` is a row's own block.
    A row is repeated once per block of its node, never once per other row.
    """
    n = blocks.cast("int")
    dealt = members.withColumn("side", F.pmod(salt, n).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.withColumn("lo", F.least("side", "_other")).withColumn("hi", F.greatest("side", "_other")).drop("_other")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``keys`` (integer columns), across batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def local_roots(linked: np.ndarray) -> np.ndarray:
    """Least index reachable from each row of a symmetric boolean matrix."""
    n = len(linked)
    root = np.arange(n)
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], n).min(axis=1, initial=n))
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def rank_among(first: np.ndarray, second: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the pairs (first, second), which ascend, are not greater than each (a, b)."""
    lo, hi = np.searchsorted(first, a), np.searchsorted(first, a, "right")
    out, cut = lo.copy(), np.flatnonzero(hi > lo)
    for k in np.unique(lo[cut]):
        here = cut[lo[cut] == k]
        out[here] = k + np.searchsorted(second[k : hi[here[0]]], b[here], "right")
    return out


def every(df: DataFrame, order: list[str], step: int) -> DataFrame:
    """About every ``step``-th row of ``df`` in order, from the middle of each such run of rows in a partition."""
    from tessera.llm.store import arrow_map

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = 0
        for batch in batches:
            at = np.arange(passed, passed + batch.num_rows)
            passed += batch.num_rows
            yield batch.filter(pa.array(at % step == step // 2))

    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return arrow_map(ordered, pick, ordered.schema)
