"""Mixing of sources by temperature, realised as permuted passes over each source.

A document's size is its number of token ids, with the end id, as the token files and the packing count it.
A source's weight is its share of the tokens to the power ``alpha``, normalised.  ``alpha`` is found by narrowing the
interval [0, 1] with a grid of exponents at a time, evaluated by one aggregation over the table of sources: the largest one
whose weights reach the target entropy, but none so small that
a source is read more often than ``max_passes``.  The budget is ``budget`` tokens or, by default, the
least at which the largest source is read once whole, so that no document is lost.  The table of sources stays in the
cluster, however many there are; the driver holds a grid's sums.

A source is then read in whole passes and one partial pass.  Each pass orders its documents by a hash
of document and pass: first by block, then inside the block.  The partial pass takes whole blocks
while the budget lasts, and of the block where it ends the documents before the first one that does not
fit, so the pass is a prefix of its order; shorter documents behind that one are not taken, and a source
may be read short of its target by less than that document's length.  A source of
n documents has about sqrt(n) blocks of sqrt(n) documents, so neither the table of blocks nor
a block is large, and no source is sorted in one task.

Defined cases: a null source is a source of its own; a null or empty text is its end id alone; a very long text is one document,
encoded in parts; rows with an equal ``doc_id`` and text are each read, in the same pass and block; sources of equal size
have equal weights; an empty table gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.store import arrow_map, materialize
from tessera.llm.tokens import default_tokenizer, encode_texts

TARGET_ENTROPY = 0.95
MAX_PASSES = 2.0
SEED = 17
#: Exponents evaluated at a time, and how often the interval is narrowed to a step of their grid.
GRID, ROUNDS = 64, 5


@dataclass(frozen=True)
class Mix:
    """``budget`` tokens, of which a source of t tokens has the share ``(t / top)**alpha / scale``."""

    alpha: float
    budget: float
    top: float
    scale: float

    def weight(self, tokens: Column) -> Column:
        return F.pow(tokens / F.lit(self.top), F.lit(self.alpha)) / F.lit(self.scale)

    def passes(self, tokens: Column) -> Column:
        """How often a source is read; one pass is exactly one."""
        return F.round(self.weight(tokens) * F.lit(self.budget) / tokens, 9)


def temperature(totals: DataFrame, target_entropy: float = TARGET_ENTROPY, max_passes: float = MAX_PASSES, budget: float | None = None) -> Mix:
    """The mixture of the sources of ``totals``, a row of ``tokens`` each. ``target_entropy`` is a share of the greatest possible, log(sources)."""
    tokens = F.col("tokens").cast("double")
    ends = totals.agg(F.max(tokens).alias("top"), F.min(tokens).alias("low"), F.count(F.lit(1)).alias("n")).first()
    top, low, n = ends["top"], ends["low"], ends["n"]
    if not n:
        return Mix(1.0, 0.0, 1.0, 1.0)
    share = (tokens / F.lit(top)).alias("share")

    def sums(alphas: list[float]) -> dict[float, tuple[float, float]]:
        """By exponent: the sum of shares to it, and the sum of these by the shares' logarithms."""
        grid = totals.select(share, F.explode(F.array(*[F.lit(a) for a in alphas])).alias("alpha")).withColumn("raw", F.pow("share", "alpha"))
        rows = grid.groupBy("alpha").agg(F.sum("raw").alias("scale"), F.sum(F.col("raw") * F.log("share")).alias("slope")).collect()
        return {r["alpha"]: (r["scale"], r["slope"]) for r in rows}

    def size(scale: float) -> float:
        return budget if budget is not None else top * scale  # the largest source once whole

    def entropy_met(alpha: float, scale: float, slope: float) -> bool:
        return math.log(scale) - alpha * slope / scale >= target_entropy * math.log(n) - 1e-12

    def passes_met(alpha: float, scale: float, slope: float) -> bool:
        """Of the smallest source, which is read most often."""
        return (low / top) ** alpha / scale * size(scale) / low <= max_passes * (1 + 1e-9)

    # Entropy falls as the exponent grows, and so do the passes of the smallest source.
    high_end, low_end = [0.0, 1.0], [0.0, 1.0]
    at = sums([0.0, 1.0])
    if entropy_met(1.0, *at[1.0]):
        high_end = [1.0, 1.0]
    if passes_met(0.0, *at[0.0]):
        low_end = [0.0, 0.0]
    for _ in range(ROUNDS):
        grids = [np.linspace(*x, GRID + 1).tolist() if x[0] < x[1] else [] for x in (high_end, low_end)]
        if not any(grids):
            break
        at = sums(sorted({a for g in grids for a in g}))
        if grids[0]:  # the last step that still reaches the goal
            k = max((i for i, a in enumerate(grids[0]) if entropy_met(a, *at[a])), default=0)
            high_end = [grids[0][k], grids[0][min(k + 1, GRID)]]
        if grids[1]:  # the first step that is within the limit, or the last one
            k = min((i for i, a in enumerate(grids[1]) if passes_met(a, *at[a])), default=GRID)
            low_end = [grids[1][max(k - 1, 0)], grids[1][k]]
    alpha = max(high_end[0], low_end[1])
    scale = sums([alpha])[alpha][0]
    return Mix(alpha, size(scale), top, scale)


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11)).cast("double") / F.lit(float(1 << 53))


def counted_rows(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(row, s, h, n_tokens): the input's columns as one struct, its source, a hash of its text and its number of token ids."""
    vocabulary, at = tokenizer or default_tokenizer(), docs.columns.index("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, sizes in encode_texts(batch.column(0).field(at).cast(pa.string()), vocabulary):
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), pa.array(sizes)], ["row", "s", "h", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("s"), F.xxhash64(text).alias("h"))
    schema = T.StructType([*rows.schema.fields, T.StructField("n_tokens", T.LongType())])
    return materialize(arrow_map(rows, count, schema), "counted-texts")


def mix_sources(
    docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_passes: float = MAX_PASSES, budget: float | None = None, seed: int = SEED, tokenizer: str | None = None
) -> DataFrame:
    """One row per reading of a document: (row, n_tokens, epoch, block), the input's columns as one struct.

    ``block`` numbers blocks of the mixture, in each of which sources stand by their weights.
    """
    counted = counted_rows(docs, tokenizer)
    totals = materialize(counted.groupBy("s").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "mix-sources")
    plan = temperature(totals, target_entropy, max_passes, budget)
    n_blocks = max(1, math.isqrt(totals.agg(F.sum("n")).first()[0] or 0))
    tokens = F.col("tokens").cast("double")
    sources = totals.select(
        F.col("s").alias("source"), plan.passes(tokens).alias("passes"), tokens.alias("tokens"), F.greatest(F.floor(F.sqrt("n")), F.lit(1)).cast("int").alias("blocks")
    )
    # Spark broadcasts the sources if they are few; else it splits the partition of a frequent one.
    read = counted.join(sources, counted["s"].eqNullSafe(sources["source"])).drop("s")
    last = F.ceil("passes").cast("int") - 1
    read = read.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)))))
    read = read.withColumn("key", _uniform(F.lit(seed), F.col("epoch"), F.col("row.doc_id"), F.col("h")))
    read = read.withColumn("part", F.floor(F.col("key") * F.col("blocks")).cast("int"))
    share = F.col("passes") - F.col("epoch")
    whole = read.filter(share >= 1)
    partial = read.filter(share < 1).withColumn("room", share * F.col("tokens"))
    # The partial pass: sums of its blocks, then where the budget ends.
    blocks = partial.groupBy("source", "part").agg(F.sum("n_tokens").alias("size"), F.max("room").alias("limit"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("part"))
    ends = materialize(
        blocks.withColumn("before", upto - F.col("size")).filter(F.col("before") < F.col("limit")).select(
            F.col("source").alias("s"), F.col("part").alias("p"), "before", ((F.col("before") + F.col("size")) <= F.col("limit")).alias("all_of_it")
        ),
        "mix-blocks",
    )
    held = partial.join(ends, partial["source"].eqNullSafe(ends["s"]) & (partial["part"] == ends["p"]))
    inside = held.filter("all_of_it")
    order = Window.partitionBy("source", "part").orderBy("key", "row.doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = held.filter("not all_of_it").withColumn("end", F.col("before") + F.sum("n_tokens").over(order)).filter(F.col("end") <= F.col("room"))
    keep = ["row", "n_tokens", "epoch", "key", "passes"]
    out = whole.select(*keep).unionByName(inside.select(*keep)).unionByName(edge.select(*keep))
    place = F.least(F.floor((F.col("epoch") + F.col("key")) / F.greatest("passes", F.lit(1e-12)) * n_blocks), F.lit(n_blocks - 1)).cast("int")
    return out.select("row", "n_tokens", "epoch", place.alias("block"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading of every document in the mixture."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("row.doc_id", "row.source", "n_tokens", "epoch", "block")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture reads them; each at least once."""
    return mix_sources(docs).select("row.*")
