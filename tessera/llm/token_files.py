"""Token ids in ORC files: written in document order, read back by stripes.

Files hold one row per document, or several of ``ROW_IDS`` ids each for a longer one, so that neither a row nor
the readers' and writers' batches of rows grow with a text.  ORC's integer run-length encoding packs the ids,
row indexes keep the least and greatest ``doc_id`` of every ``row_stride`` rows, and a
Bloom filter on ``doc_id`` lets a look-up skip stripes.  Every row says which document of its file's range it
belongs to (``document``), which part of it it is and how many ids stand before it in the range (``before``), so that
a reader that starts in the middle of a file, at any stripe, knows its place once the ranges' totals are added up.

Defined cases: a null text is an empty one (its ids are the end id alone); rows with equal
``doc_id`` are ordered by a hash of their texts, so that they need not meet in one task, and each keeps its place;
a null ``doc_id`` sorts first; a very long text is encoded in parts and stored in rows of ``ROW_IDS`` ids; an
empty table gives files without rows.  Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.groups import every, rank_among
from tessera.llm.store import arrow_map, materialize, new_path
from tessera.llm.tokens import default_tokenizer, encode_texts, id_type, ids_crc32

FILE_SCHEMA = "doc_id long, file_range int, document long, part int, before long, ids array<int>"
#: Ids in a row of a file at most.
ROW_IDS = 4096
#: Sampled documents for each bound of a range.
PER_RANGE = 100
_NULL = -(1 << 63)


@dataclass
class Ranges:
    """The first (doc_id, spread) of every range of documents but the first, in order; a null id comes before all."""

    ids: np.ndarray
    spreads: np.ndarray


def document_ranges(rows: DataFrame, n: int) -> Ranges:
    """Bounds of ``n`` ranges, or about so many, from a random sample; so many rows are gathered."""
    rate = min(1.0, n * PER_RANGE / max(1, rows.count()))
    sample = materialize(rows.filter(F.rand(3) < rate).select(F.coalesce("doc_id", F.lit(_NULL)).alias("id"), "spread"), "id-sample")
    found = sorted({tuple(r) for r in every(sample, ["id", "spread"], PER_RANGE).collect()})
    return Ranges(*(np.array(x, np.int64) for x in zip(*found, strict=True))) if found else Ranges(np.zeros(0, np.int64), np.zeros(0, np.int64))


def encoded(rows: DataFrame, ranges: Ranges, vocabulary: str) -> DataFrame:
    """(file_range, doc_id, spread, row, part, n, ids): rows of ``n`` ids, ``ROW_IDS`` at most, as bytes; ``row`` tells documents apart."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, wide = TaskContext.get().partitionId() << 33, id_type(vocabulary)
        for batch in batches:
            id_, spread = (pc.fill_null(batch.column(i), _NULL).to_numpy() for i in (0, 1))
            where = rank_among(ranges.ids, ranges.spreads, id_, spread).astype(np.int32)
            for lo, hi, ids, sizes in encode_texts(batch.column(2), vocabulary):
                many = -(-sizes // ROW_IDS)
                doc = np.repeat(np.arange(hi - lo), many)
                part = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                begin = np.append((np.cumsum(sizes) - sizes)[doc] + part * ROW_IDS, len(ids)).astype(np.int32)
                raw = [None, pa.py_buffer(begin * wide.itemsize), pa.py_buffer(ids.astype(wide))]
                own = [batch.column(i).slice(lo, hi - lo).take(pa.array(doc)) for i in (0, 1)]
                columns = [pa.array(where[lo:hi][doc]), *own, pa.array(row + doc), pa.array(part.astype(np.int32)), pa.array(np.diff(begin))]
                yield pa.RecordBatch.from_arrays([*columns, pa.Array.from_buffers(pa.binary(), len(doc), raw)], ["file_range", "doc_id", "spread", "row", "part", "n", "ids"])
                row += hi - lo

    return arrow_map(rows, encode, "file_range int, doc_id long, spread long, row long, part int, n int, ids binary")


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, row_stride: int = 1000, stripe_mb: int = 16) -> None:
    """Encode ``docs`` (doc_id, text) and write them to ``path`` in ascending ``doc_id`` order.

    Texts are encoded where they are read, and their ids are moved to ranges of documents, whose bounds come from a sample,
    so that no row of one id, or without an id, need meet all others of it.
    """
    vocabulary = tokenizer or default_tokenizer()
    wide = id_type(vocabulary)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before, document = -1, 0, -1
        for batch in batches:
            raw, part, where = batch.column(3), batch.column(2).to_numpy(), batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(where)] if len(where) else []
            ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1] // wide.itemsize if len(where) else None
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if where[a] != last:
                    last, before, document = where[a], 0, -1
                size = ends[a : b + 1] - ends[a]
                ids = np.frombuffer(raw.buffers()[2], wide)[ends[a] : ends[b]].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(a, b - a),
                        batch.column(0).slice(a, b - a),
                        pa.array(document + np.cumsum(part[a:b] == 0)),
                        batch.column(2).slice(a, b - a),
                        pa.array(before + size[:-1].astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(size), pa.array(ids)),
                    ],
                    ["doc_id", "file_range", "document", "part", "before", "ids"],
                )
                before, document = before + len(ids), document + int((part[a:b] == 0).sum())

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("spread"), text.alias("text"))
    ranges = document_ranges(rows, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    moved = encoded(rows, ranges, vocabulary).repartition("file_range").sortWithinPartitions("file_range", "doc_id", "spread", "row", "part")
    (
        arrow_map(moved.select("file_range", "doc_id", "part", "ids"), number, FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(row_stride))
        .option("orc.stripe.size", str(stripe_mb << 20))
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; filters on ``doc_id`` are pushed to the stripes' statistics and Bloom filters."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """(file_range, base): ids in all ranges before this one.  One row per range is gathered, none per document."""
    totals = read_token_files(spark, path).groupBy("file_range").agg(F.max(F.col("before") + F.size("ids")).alias("n")).collect()  # one per range
    rows, base = [], 0
    for row in sorted(totals, key=lambda r: r["file_range"]):
        rows.append((row["file_range"], base))
        base += row["n"]
    return spark.createDataFrame(rows, "file_range int, base long")


def joined_crc32(parts: list[dict]) -> int:
    """CRC-32 of the parts one after the other from those of each: zeros in a part's place shift what stands before."""
    total = 0
    for p in parts:
        zeros = bytes(4 * p["n"])
        total = zlib.crc32(zeros, total) ^ zlib.crc32(zeros) ^ p["crc"]
    return total


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: start, n_tokens and the CRC-32 of its ids.

    What leaves a row of a file is its length and CRC-32; those of a document's rows, which may lie in several
    stripes and so be read by several tasks, are put together.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(5)
            offsets, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
            sums = [ids_crc32(ids[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.diff(offsets)), pa.array(sums, pa.int64())], ["doc_id", "file_range", "document", "part", "before", "n", "crc"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.array([joined_crc32(p) for p in batch.column(4).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], sums], ["doc_id", "file_range", "before", "n_tokens", "ids_crc32"])

    rows = arrow_map(read_token_files(spark, path), digest, "doc_id long, file_range int, document long, part int, before long, n int, crc long")
    whole = rows.groupBy("file_range", "document").agg(
        F.first("doc_id").alias("doc_id"), F.min("before").alias("before"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("part", "n", "crc"))).alias("parts")
    )
    out = arrow_map(whole.select("doc_id", "file_range", "before", "n_tokens", "parts"), join, "doc_id long, file_range int, before long, n_tokens long, ids_crc32 long")
    # One row per range: their number bounds what is broadcast.
    return out.join(F.broadcast(file_starts(spark, path)), "file_range").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` through the file format and back."""
    path = new_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    return token_digest(spark, path)
