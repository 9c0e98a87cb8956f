"""Python values to Spark literals and rows, and which types can be compared."""

from __future__ import annotations

import datetime as dt
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.lang.parser import QueryError
from tessera.lang.tree import Stamp

#: A list of at least so many floats is a vector of 32-bit floats.
VECTOR_LENGTH = 64


def to_time(stamp: Stamp) -> dt.datetime:
    try:
        return dt.datetime.fromisoformat(stamp.text)
    except ValueError as e:
        raise QueryError(f"not a date: {stamp.text}") from e


def kind_of_type(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if isinstance(kind, T.ArrayType):
        return "list"
    if isinstance(kind, T.VariantType):
        return "variant"
    return "map" if isinstance(kind, (T.StructType, T.MapType)) else "other"


def kind_of_value(value: Any) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "text"
    if isinstance(value, (Stamp, dt.datetime, dt.date)):
        return "time"
    if isinstance(value, (list, tuple)):
        return "list"
    return "null" if value is None else "map"


def comparable(value: Any, kind: T.DataType) -> bool:
    """A literal and a column of different kinds never compare; nothing is cast between text and numbers."""
    mine, theirs = kind_of_value(value), kind_of_type(kind)
    if mine == "list" and theirs == "list":
        return all(comparable(v, kind.elementType) for v in value)
    return mine == theirs


def literal(value: Any, kind: T.DataType | None = None) -> Column:
    if isinstance(value, Stamp):
        value = to_time(value)
    if isinstance(value, dt.datetime) and isinstance(kind, T.TimestampNTZType):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(value, (list, tuple)):
        element = kind.elementType if isinstance(kind, T.ArrayType) else None
        return F.array(*[literal(v, element) for v in value]).cast(kind) if kind is not None else F.array(*[literal(v) for v in value])
    return F.lit(value)


def infer(value: Any) -> T.DataType | None:
    """Spark type of a field value; None for null; VARIANT where the parts of a list disagree."""
    kind = kind_of_value(value)
    if kind == "null":
        return None
    if kind == "list":
        if len(value) >= VECTOR_LENGTH and all(isinstance(v, float) for v in value):
            return T.ArrayType(T.FloatType())
        inner = None
        for v in value:
            inner = unify(inner, infer(v))
        return T.ArrayType(inner or T.NullType())
    if kind == "map":
        return T.StructType([T.StructField(k, infer(v) or T.NullType()) for k, v in value.items()])
    return {"bool": T.BooleanType(), "text": T.StringType(), "time": T.TimestampType()}.get(kind) or (T.LongType() if isinstance(value, int) else T.DoubleType())


def unify(a: T.DataType | None, b: T.DataType | None) -> T.DataType | None:
    """The type that holds both: Int and Float become Float, maps and lists unify by their parts, all else VARIANT."""
    if a is None or b is None or a == b:
        return a or b
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        inner = unify(a.elementType, b.elementType)
        return T.ArrayType(inner) if not isinstance(inner, T.VariantType) else T.VariantType()
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = list(dict.fromkeys([*a.names, *b.names]))
        inside = {n: unify(a[n].dataType if n in a.names else None, b[n].dataType if n in b.names else None) for n in names}
        return T.StructType([T.StructField(n, k) for n, k in inside.items()])
    return T.VariantType()


def settle(kind: T.DataType | None) -> T.DataType:
    """A type to store: what is only ever null is text, and a field with disagreeing parts anywhere is VARIANT as a whole."""

    def mixed(k: T.DataType) -> bool:
        if isinstance(k, T.ArrayType):
            return mixed(k.elementType)
        return any(mixed(f.dataType) for f in k.fields) if isinstance(k, T.StructType) else isinstance(k, T.VariantType)

    def filled(k: T.DataType) -> T.DataType:
        if isinstance(k, T.ArrayType):
            return T.ArrayType(filled(k.elementType))
        if isinstance(k, T.StructType):
            return T.StructType([T.StructField(f.name, filled(f.dataType)) for f in k.fields]) if k.fields else T.VariantType()
        return T.StringType() if isinstance(k, T.NullType) else k

    if kind is None:
        return T.StringType()
    kind = filled(kind)
    return T.VariantType() if mixed(kind) else kind


def plain(value: Any, kind: T.DataType) -> Any:
    """A Python value as ``createDataFrame`` wants it for ``kind``; VARIANT fields go in as JSON text."""
    if value is None:
        return None
    if isinstance(kind, T.VariantType):
        return json.dumps(value, default=lambda v: v.text if isinstance(v, Stamp) else str(v))
    if isinstance(value, Stamp):
        return to_time(value)
    if isinstance(kind, T.ArrayType):
        return [plain(v, kind.elementType) for v in value]
    if isinstance(kind, T.StructType):
        return {f.name: plain(value.get(f.name), f.dataType) for f in kind.fields}
    return float(value) if isinstance(kind, (T.DoubleType, T.FloatType)) else value
