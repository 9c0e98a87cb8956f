"""Managed datasets: Parquet parts named by the catalog, never changed in place.

A write adds a part or, where rows change, rewrites the touched cluster buckets: the old parts stay and
the catalog notes which of their buckets no longer count.  Readers keep the catalog version they began
with.  Every record has ``_lid``, ``_type``, ``_created_at``, ``_updated_at``, ``_nulls`` (fields set to null), ``_key``
(cluster key), ``_rooted`` (placed with a parent) and ``_bucket``.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.keys import BUCKETS, bucket_of, cluster_key
from tessera.functions.values import infer, plain, settle, unify
from tessera.lang.parser import QueryError
from tessera.lang.tree import Gravity
from tessera.plans.predicates import resolve

SYSTEM = {
    "_lid": T.StringType(),
    "_type": T.StringType(),
    "_created_at": T.TimestampType(),
    "_updated_at": T.TimestampType(),
    "_nulls": T.ArrayType(T.StringType()),
    "_key": T.StringType(),
    "_rooted": T.BooleanType(),
    "_bucket": T.IntegerType(),
}
BATCH_MAX = 10_000
#: So many parts of one level at the end of a dataset are merged into one of the next level.
MERGE_AT = 16
_PART = "_part"
#: Tells the new rows of a rewritten part from those that were kept.
MARK = "_write"


def new_entry(buckets: int = BUCKETS) -> dict:
    return {"buckets": buckets, "hint": None, "anchors": [], "gravity": None, "satellite": None, "vector": None, "dim": None, "pins": [], "parts": [], "schema": None, "rooted": [], "batches": [], "streams": {}}


def gravity_of(entry: dict) -> Gravity | None:
    return Gravity(entry["gravity"][0], tuple(entry["gravity"][1])) if entry["gravity"] else None


def schema_of(entry: dict) -> T.StructType:
    if entry["schema"]:
        return T.StructType.fromJson(entry["schema"])
    return T.StructType([T.StructField(n, k) for n, k in SYSTEM.items()])


def user_fields(schema: T.StructType) -> list[str]:
    return [n for n in schema.names if n not in SYSTEM]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns and types of ``schema``; missing ones are null."""
    out = []
    for field in schema.fields:
        if field.name not in df.columns:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif df.schema[field.name].dataType != field.dataType:
            out.append(_convert(F.col(f"`{field.name}`"), df.schema[field.name].dataType, field.dataType).alias(field.name))
        else:
            out.append(F.col(f"`{field.name}`"))
    return df.select(*out)


def _convert(column: Column, have: T.DataType, want: T.DataType) -> Column:
    if isinstance(want, T.VariantType):
        return F.parse_json(F.to_json(column)) if isinstance(have, (T.StructType, T.MapType, T.ArrayType)) else column.cast("variant")
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        inner = [
            (_convert(column.getField(f.name), have[f.name].dataType, f.dataType) if f.name in have.names else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in want.fields
        ]
        return F.when(column.isNotNull(), F.struct(*inner))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType) and have.elementType != want.elementType:
        return F.transform(column, lambda x: _convert(x, have.elementType, want.elementType))
    return column.cast(want)


def merge_schemas(a: T.StructType, b: T.StructType) -> T.StructType:
    fields = {f.name: f.dataType for f in a.fields}
    for f in b.fields:
        fields[f.name] = settle(unify(fields.get(f.name), f.dataType))
    order = [n for n in SYSTEM if n in fields] + [n for n in fields if n not in SYSTEM]
    return T.StructType([T.StructField(n, fields[n]) for n in order])


def read_part(spark: SparkSession, part: dict, mark: bool = False) -> DataFrame:
    """One part, with the schema that it was written with; a part may hold no file.  ``mark`` adds the rewriting's own column."""
    return _read_parts(spark, [part], mark)


def _read_parts(spark: SparkSession, parts: list[dict], mark: bool = False) -> DataFrame:
    """Parts of one schema in one scan.  Each is a partition directory of its dataset, so that the buckets of it that count
    no more are pruned as partitions."""
    schema = T.StructType.fromJson(parts[0]["schema"])
    if mark:
        schema = schema.add(MARK, T.StringType())
    base = parts[0]["path"].rpartition("/")[0]
    df = spark.read.schema(T.StructType([*schema.fields, T.StructField(_PART, T.StringType())])).option("basePath", base).parquet(*[p["path"] for p in parts])
    for part in parts:
        if part["drop"]:
            df = df.filter((F.col(_PART) != part["path"].rpartition("=")[2]) | ~F.col("_bucket").isin(part["drop"]))
    return df.select(*[F.col(f"`{c}`") for c in schema.names])


def read(spark: SparkSession, entry: dict) -> DataFrame:
    """All records as of the catalog's entry: one scan for each schema that parts were written with."""
    schema = schema_of(entry)
    alike: dict[tuple, list[dict]] = {}
    for part in entry["parts"]:
        alike.setdefault((json.dumps(part["schema"], sort_keys=True), part["path"].rpartition("/")[0]), []).append(part)
    frames = [conform(_read_parts(spark, parts), schema) for parts in alike.values()]
    if not frames:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, frames)


def from_records(spark: SparkSession, records: list[dict]) -> DataFrame:
    """A batch of records given as Python values, with ``_nulls`` for fields set to null."""
    kinds: dict[str, Any] = {}
    for record in records:
        for name, value in record.items():
            kinds[name] = unify(kinds.get(name), infer(value))
    schema = T.StructType([T.StructField(n, settle(k) if k is not None else T.NullType()) for n, k in kinds.items()] + [T.StructField("_nulls", SYSTEM["_nulls"])])
    loose = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.VariantType) else f.dataType) for f in schema.fields])
    rows = []
    for record in records:
        nulls = [n for n, v in record.items() if v is None]
        rows.append(tuple(plain(record.get(f.name), f.dataType) for f in schema.fields[:-1]) + (nulls or None,))
    df = spark.createDataFrame(rows, loose)
    for f in schema.fields:
        if isinstance(f.dataType, T.VariantType):
            df = df.withColumn(f.name, F.parse_json(f.name))
    return df


def stamp(df: DataFrame, name: str, entry: dict, now_micros: int, key: Column | None = None) -> DataFrame:
    """New records with their system columns; ``key`` places them with a parent."""
    time = F.timestamp_micros(F.lit(now_micros))
    if "_type" not in df.columns:
        df = df.withColumn("_type", F.lit(name))
    if "_nulls" not in df.columns:
        df = df.withColumn("_nulls", F.lit(None).cast(SYSTEM["_nulls"]))
    lid = F.concat(F.lit(f"{now_micros:016x}-"), F.lpad(F.lower(F.hex(F.monotonically_increasing_id())), 16, "0"))
    df = df.withColumns({"_type": F.coalesce("_type", F.lit(name)), "_lid": lid, "_created_at": time, "_updated_at": time, "_rooted": F.lit(key is not None)})
    return place(df, entry, key)


def place(df: DataFrame, entry: dict, key: Column | None = None) -> DataFrame:
    """``_key`` and ``_bucket`` by the declaration; records placed with a parent keep its key."""
    spec = gravity_of(entry)

    def of(field: str) -> Column:
        found = resolve(df.schema, field)
        return found[0] if found else F.lit(None)

    own = cluster_key(spec, of) if spec else F.lit(None).cast("string")
    if key is not None:
        own = key
    elif "_key" in df.columns:
        own = F.when(F.col("_rooted"), F.col("_key")).otherwise(own)
    return df.withColumn("_key", own).withColumn("_bucket", bucket_of(F.col("_key"), entry["buckets"]))


def write_part(spark: SparkSession, root: str, name: str, entry: dict, df: DataFrame, drop: list[int] | None = None, replace: bool = False) -> dict:
    """The entry after ``df`` was written as a new part.  ``drop`` buckets of older parts count no more; ``replace`` drops all."""
    schema = merge_schemas(schema_of(entry), df.schema)
    df = conform(df, T.StructType([schema[c] for c in df.columns]))  # a field that was only set to null has no type yet
    path = f"{root}/data/{name}/{_PART}=p{uuid.uuid4().hex}"
    order = ["_bucket", "_key"] + ([entry["satellite"]] if entry["satellite"] in df.columns else [])
    if entry["gravity"]:
        # Buckets together, so that files are whole, but a bucket that one key fills is split over several writers.
        # Inside they are sorted so that row groups can be skipped.
        df = df.hint("rebalance", F.col("_bucket"))
    df = df.sortWithinPartitions(*order)
    writer = df.write.partitionBy("_bucket") if entry["gravity"] else df.write
    writer.parquet(path)
    parts = [] if replace else [{**p, "drop": sorted({*p["drop"], *(drop or [])})} for p in entry["parts"]]
    return {**entry, "schema": schema.jsonValue(), "parts": [*parts, {"path": path, "drop": [], "schema": _plain_schema(df.schema).jsonValue(), "level": 0}]}


def _plain_schema(schema: T.StructType) -> T.StructType:
    """What parts are alike by: their fields by name, whatever their order."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in sorted(schema.fields, key=lambda f: f.name) if f.name != MARK])


def merge_tail(spark: SparkSession, root: str, name: str, entry: dict) -> dict:
    """The entry with its newest parts merged where ``MERGE_AT`` of a level have come together, so that a dataset of n writes has
    about log n parts and a record is rewritten as often."""
    while True:
        parts = entry["parts"]
        level = parts[-1]["level"] if parts else 0
        tail = 0
        while tail < len(parts) and parts[-1 - tail]["level"] == level:
            tail += 1
        if tail < MERGE_AT:
            return entry
        written = write_part(spark, root, name, entry, read(spark, {**entry, "parts": parts[-tail:]}), replace=True)
        entry = {**written, "parts": [*parts[:-tail], {**written["parts"][0], "level": level + 1}]}


def keyed(keys: DataFrame, n: int) -> DataFrame:
    """A side of a join that holds ``n`` keys: broadcast if one batch can hold as many, else merged.  Spark's own estimate of a
    narrow column is by its share of compressed files and so low that all keys of a dataset would go through the driver."""
    return keys.hint("broadcast" if n <= BATCH_MAX else "merge")


def check_unique(df: DataFrame, existing: DataFrame | None, field: str) -> int:
    """Raise if ``df`` repeats a value of ``field`` or shares one with ``existing``; returns how many values it has."""
    if field not in df.columns:
        return 0
    keys = df.filter(F.col(f"`{field}`").isNotNull()).select(F.col(f"`{field}`").alias("k"))
    counts = keys.groupBy("k").count()
    sums = counts.agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("most")).first()
    twice = counts.filter("count > 1").limit(1).collect() if sums["n"] and sums["most"] > 1 else []
    if sums["n"] and not twice and existing is not None and field in existing.columns:
        have = existing.filter(F.col(f"`{field}`").isNotNull()).select(F.col(f"`{field}`").alias("k"))
        twice = have.join(keyed(keys, sums["n"]), "k", "left_semi").limit(1).collect()
    if twice:
        raise QueryError(f"anchor {field} is unique: {twice[0]['k']!r} is there already")
    return sums["n"]


def check_vectors(df: DataFrame, entry: dict) -> int | None:
    """Dimension of the declared vector field after this write; other lengths are refused."""
    field = entry["vector"]
    if not field or field not in df.columns:
        return entry["dim"]
    if not isinstance(df.schema[field].dataType, T.ArrayType):
        raise QueryError(f"{field} is the vector field; it holds lists of numbers")
    sizes = df.filter(F.col(f"`{field}`").isNotNull()).agg(F.min(F.size(field)).alias("a"), F.max(F.size(field)).alias("b")).first()
    if sizes["a"] is None:
        return entry["dim"]
    if sizes["a"] != sizes["b"] or (entry["dim"] and entry["dim"] != sizes["a"]):
        raise QueryError(f"vector field {field} has dimension {entry['dim'] or sizes['a']}; a record has another")
    return sizes["a"]
