"""Cluster keys: one text per record, whatever the declaration, and the bucket it falls into."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.lang.tree import Gravity

#: Partitions of a dataset unless its session says otherwise; a write rewrites whole partitions.
BUCKETS = 64


def fold(kind: str, value: Column) -> Column:
    """``lower`` and ``trim`` as identities fold them: trim takes off every Unicode blank."""
    if kind == "lower":
        return F.lower(value)
    if kind == "trim":
        return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    return value


def cluster_key(spec: Gravity, of) -> Column:
    """The key as text; ``of(field)`` gives a field's column. Parts of a composite are joined by a zero byte."""
    if spec.kind == "composite":
        whole = F.concat_ws("\0", *[F.coalesce(of(f).cast("string"), F.lit("")) for f in spec.fields])
        some = F.coalesce(*[of(f).cast("string") for f in spec.fields])
        return F.when(some.isNotNull(), whole)
    return fold(spec.kind, of(spec.fields[0]).cast("string"))


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    """The partition of a key; records without a key share the first."""
    return F.coalesce(F.pmod(F.xxhash64(key), F.lit(buckets)), F.lit(0)).cast("int")
