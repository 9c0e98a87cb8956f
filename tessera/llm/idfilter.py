"""A bitmap of fixed size that spares most rows without a partner from being moved to a join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import arrow_map

#: 4 MB, whatever the corpus.  Fuller maps let more rows through; none that has a partner is lost.
FILTER_BITS = 1 << 25


def maybe_in(rows: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose ``key`` may be in ``wanted``: all that are, and a few more.  The exact join follows.

    The map is made by aggregation and is at most ``FILTER_BITS`` bits however many keys go in, so
    it is safe to gather and broadcast.
    """
    spot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    # The bitmap functions number positions from 1: position s + 1 is bit s % 32768 of bucket 1 + s div 32768.
    at = spot + 1
    bits = wanted.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    found = {row["bucket"]: bytes(row["bits"]) for row in bits.collect()}  # at most FILTER_BITS / 32768 rows of 4 KB
    joined = b"".join(found.get(i + 1, bytes(1 << 12)) for i in range(FILTER_BITS >> 15))
    shared = rows.sparkSession.sparkContext.broadcast(joined)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            s = batch.column(batch.num_columns - 1).to_numpy()
            yield batch.filter(pa.array((held[s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool)))

    marked = rows.withColumn("_spot", spot)
    return arrow_map(marked, keep, marked.schema).drop("_spot")
