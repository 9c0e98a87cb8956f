"""Removal of long passages that an earlier document already has.

A window is ``WINDOW`` consecutive words.  Anchors are hashes of shorter runs of words at the positions
of a difference cover: for any two positions i and j some shift d below the period puts both
i + d and j + d on the cover, so two equal windows hold one equal anchor at the same place
(``ANCHOR + PERIOD - 1 <= WINDOW``).  Only about a fifth of all positions are hashed and moved.

1. Anchors that stand in two documents or more are found by an aggregation.
2. Around them, and nowhere else, matches are extended: windows that hold such an anchor are hashed whole,
   and the least document of each window's hash is found by an aggregation.
3. Windows with a lesser document elsewhere are removed, and the words they cover with them.

Texts equal to an earlier one as a whole need none of this: all their windows start earlier.
Aggregations combine per task, so a passage that a third of all documents share moves as one row
per task; the joins back to positions are plain equi-joins that Spark splits where a key is hot.

Defined cases: a null text has no words; a text of fewer than ``WINDOW`` words has no window and stays; a very long text has all its windows compared;
rows with the same ``doc_id`` are not smaller than each other and keep what they share; a null
``doc_id`` is neither smaller nor greater than any and stays whole; an empty table gives no rows; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.idfilter import maybe_in
from tessera.llm.store import arrow_map, materialize
from tessera.llm.words import Words, each_slice, windows

WINDOW = 50
#: A perfect difference set: every residue modulo 31 is a difference of two of its members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
_ANCHOR_BASE = 0xE7037ED1A0B428DB | 1
_WINDOW_BASES = (0x8EBC6AF09C88C6E3 | 1, 0x589965CC75374CC3 | 1)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"), text.alias("text"))


def cover_positions(words: Words) -> np.ndarray:
    """Positions of the slice's words where an anchor starts: on the cover, counted from the document's start."""
    counts = words.counts()
    last = np.repeat(words.first[:-1] + np.maximum(counts - ANCHOR + 1, 0), counts)
    at = np.arange(len(last))
    inside = at - np.repeat(words.first[:-1], counts)
    on = np.zeros(PERIOD, bool)
    on[list(COVER)] = True
    return at[on[inside % PERIOD] & (at < last) & np.repeat(counts >= WINDOW, counts)]


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n_words, sha256) of every whole text, words joined by one space."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums = [], []
            for text in batch.column(3).cast(pa.large_binary()).to_pylist():
                words = text.split()
                counts.append(len(words))
                sums.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(sums, pa.string())], ["doc_id", "k1", "k2", "n_words", "sha256"])

    return arrow_map(_texts(docs), digest, "doc_id long, k1 long, k2 long, n_words long, sha256 string")


def anchors(docs: DataFrame) -> DataFrame:
    """(anchor, doc_id, position) at the cover's positions of every text that has a window."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in each_slice(batch.column(3)):
                at = cover_positions(words)
                if not len(at):
                    continue
                doc = words.doc_of()[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        _long(windows(words.hashes(), ANCHOR, _ANCHOR_BASE, at)),
                        batch.column(0).slice(lo, hi - lo).take(pa.array(doc)),
                        batch.column(1).slice(lo, hi - lo).take(pa.array(doc)),
                        pa.array((at - words.first[doc]).astype(np.int32)),
                    ],
                    ["anchor", "doc_id", "k1", "position"],
                )

    return arrow_map(_texts(docs).filter("doc_id IS NOT NULL"), find, "anchor long, doc_id long, k1 long, position int")


def _candidate_starts(count: int, positions: np.ndarray) -> np.ndarray:
    """Windows of a text of ``count`` words that hold an anchor at one of the positions."""
    spread = (positions[:, None] - np.arange(PERIOD)[None, :]).ravel()
    return np.unique(spread[(spread >= 0) & (spread <= count - WINDOW)])


def candidate_windows(candidates: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, k1, position) of the windows around each text's shared anchors."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for lo, hi, words in each_slice(batch.column(2)):
                counts = words.counts()
                starts = [_candidate_starts(int(counts[d]), flat[offsets[lo + d] : offsets[lo + d + 1]]) for d in range(hi - lo)]
                doc = np.repeat(np.arange(hi - lo), [len(s) for s in starts])
                if not len(doc):
                    continue
                position = np.concatenate(starts)
                at = words.first[doc] + position
                hashes = words.hashes()
                h1, h2 = (windows(hashes, WINDOW, base, at) for base in _WINDOW_BASES)
                yield pa.RecordBatch.from_arrays(
                    [
                        _long(h1),
                        pa.array((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        *(batch.column(i).slice(lo, hi - lo).take(pa.array(doc)) for i in (0, 1)),
                        pa.array(position.astype(np.int32)),
                    ],
                    ["h1", "h2", "doc_id", "k1", "position"],
                )

    return arrow_map(candidates, extend, "h1 long, h2 int, doc_id long, k1 long, position int")


def kept_words(text: bytes, starts: np.ndarray) -> tuple[int, bytes]:
    """(words removed, the others joined by one space) when the windows at ``starts`` go."""
    words = text.split()
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + WINDOW, len(words)), -1)
    keep = np.cumsum(edge[:-1]) == 0
    return len(words) - int(keep.sum()), b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def drop_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs`` (doc_id, text)."""
    whole = materialize(digests(docs), "digests")
    firsts = whole.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("n_words").alias("n"))
    firsts = materialize(firsts.filter("last > first").select("k1", "k2", "first"), "repeated-texts")
    copies = materialize(
        whole.filter(F.col("n_words") >= WINDOW).join(firsts, ["k1", "k2"]).filter("doc_id > first").select("doc_id", "k1", "k2").distinct(), "copies"
    )
    found = anchors(docs)
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor")
    shared = materialize(shared, "shared-anchors")
    spots = found.join(shared, "anchor").groupBy("doc_id", "k1").agg(F.collect_list("position").alias("positions"))
    spots = materialize(spots.join(copies, ["doc_id", "k1"], "left_anti"), "anchor-spots")
    texts = maybe_in(_texts(docs), spots)
    texts = materialize(texts.join(spots, ["doc_id", "k1"]).select("doc_id", "k1", "text", "positions"), "candidate-texts")
    held = candidate_windows(texts)
    least = held.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("h1", "h2", F.col("a").alias("first"))
    least = materialize(least, "first-windows")
    gone = held.join(least, ["h1", "h2"]).filter("doc_id > first").groupBy("doc_id", "k1").agg(F.collect_set("position").alias("gone"))
    edited = texts.select("doc_id", "k1", "text").join(gone, ["doc_id", "k1"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            out = [kept_words(t, flat[a:b]) for t, a, b in zip(batch.column(2).cast(pa.large_binary()).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            sums = [hashlib.sha256(kept).hexdigest() for _, kept in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for n, _ in out], pa.int64()), pa.array(sums, pa.string())], ["doc_id", "k1", "n", "sha"])

    changed = arrow_map(edited.select("doc_id", "k1", "text", "gone"), remove, "doc_id long, k1 long, n long, sha string").dropDuplicates(["doc_id", "k1"])
    nothing = hashlib.sha256(b"").hexdigest()
    empty = copies.join(whole.select("doc_id", "k1", "n_words").distinct(), ["doc_id", "k1"]).select("doc_id", "k1", F.col("n_words").alias("n"), F.lit(nothing).alias("sha"))
    edits = materialize(changed.unionByName(empty), "edits")
    id_, key = edits["doc_id"], edits["k1"]
    joined = whole.join(edits, whole["doc_id"].eqNullSafe(id_) & (whole["k1"] == key), "left")
    return joined.select(whole["doc_id"], "n_words", F.coalesce("n", F.lit(0)).alias("n_removed"), F.coalesce("sha", "sha256").alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: words removed, and the SHA-256 of what stays."""
    return drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = f"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') AS ws FROM documents),
spots AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS p FROM split WHERE len(ws) >= {WINDOW}),
wins AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + {WINDOW - 1}], ' ')) AS h FROM spots),
least AS (SELECT h, min(doc_id) AS first FROM wins GROUP BY h),
gone AS (SELECT DISTINCT w.doc_id, w.p + j AS q FROM wins w JOIN least USING (h), range({WINDOW}) r(j) WHERE w.doc_id > least.first),
sets AS (SELECT doc_id, count(*) AS n, list(q) AS qs FROM gone GROUP BY doc_id)
SELECT s.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(qs, i)) END, ' ')) AS kept_sha256
FROM split s LEFT JOIN sets USING (doc_id)
"""
