"""Predicates as Columns, with two truth values.

A leaf over a missing field is false, and NOT turns it into true, which SQL's three values do not do.  Under AND
and OR a null leaf filters like a false one, so leaves stay bare there and are pushed to the scan; under an odd
number of NOTs equality is null-safe, which is pushed too, and the other leaves are coalesced.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.values import comparable, kind_of_type, kind_of_value, literal
from tessera.lang import tree as t
from tessera.lang.parser import QueryError

NULLS = "_nulls"


def resolve(schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    """Column and type of a dotted path through maps and lists; None where no record can have it."""
    head, *rest = path.split(".")
    if head not in schema.names:
        return None
    column, kind = F.col(f"`{head}`"), schema[head].dataType
    for i, part in enumerate(rest):
        if isinstance(kind, T.StructType):
            if part not in kind.names:
                return None
            column, kind = column.getField(part), kind[part].dataType
        elif isinstance(kind, T.MapType):
            column, kind = F.try_element_at(column, F.lit(part)), kind.valueType
        elif isinstance(kind, T.ArrayType):
            if not part.isdigit():
                return None
            column, kind = F.get(column, int(part)), kind.elementType
        elif isinstance(kind, T.VariantType):
            steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in rest[i:])
            return F.expr(f"try_variant_get(`{head}`, '$', 'variant')") if not steps else F.try_variant_get(column, f"${steps}", "variant"), kind
        else:
            return None
    return column, kind


class Predicates:
    """Compiles predicates for one schema.  ``_nulls`` lists fields that were set to null; a plain null is a missing field."""

    def __init__(self, schema: T.StructType, strict_types: bool = False):
        self.schema, self.strict = schema, strict_types
        self.presence = NULLS in schema.names

    def compile(self, node: Any, negated: bool = False) -> Column:
        if node is None:
            return F.lit(True)
        if isinstance(node, t.Not):
            return ~self.compile(node.part, not negated)
        if isinstance(node, (t.And, t.Or)):
            parts = [self.compile(p, negated) for p in node.parts]
            out = parts[0]
            for part in parts[1:]:
                out = out & part if isinstance(node, t.And) else out | part
            return out
        if isinstance(node, t.Leaf):
            return self.leaf(node, negated)
        raise QueryError(f"not a predicate: {node}")

    def _explicit_null(self, path: str) -> Column:
        if not self.presence or "." in path:
            return F.lit(False)
        return F.coalesce(F.array_contains(F.col(NULLS), path), F.lit(False))

    def leaf(self, leaf: t.Leaf, negated: bool) -> Column:
        found = resolve(self.schema, leaf.path)
        if found is None:
            return F.lit(leaf.op == "isnull")
        column, kind = found
        op, value = leaf.op, leaf.value
        if isinstance(value, t.Param):
            raise QueryError(f"no value for parameter ${value.name}")
        if op == "isnull":
            return column.isNull()
        if op == "notnull":
            return column.isNotNull()
        if kind_of_type(kind) == "variant" and op != "contains":
            want = {"bool": "boolean", "number": "double", "text": "string", "time": "timestamp"}.get(kind_of_value(value[0] if op == "in" and value else value))
            if want:
                column, kind = F.try_variant_get(column, "$", want), T._parse_datatype_string(want)
        if op == "contains":
            if not isinstance(kind, T.ArrayType) or kind_of_type(kind.elementType) == "variant" or not self._fits(value, kind.elementType):
                return F.lit(False)
            return self._closed(F.array_contains(column, literal(value, kind.elementType)), negated)
        if op == "in":
            values = [v for v in value if v is not None and self._fits(v, kind)]
            out = column.isin([literal(v, kind) for v in values]) if values else F.lit(False)
            if None in value:
                return F.coalesce(out, F.lit(False)) | self._explicit_null(leaf.path)
            return self._closed(out, negated)
        if value is None:
            if op == "=":
                return self._explicit_null(leaf.path)
            return column.isNotNull() if op == "!=" else F.lit(False)
        fits = self._fits(value, kind)
        if op == "=":
            if not fits:
                return F.lit(False)
            return column.eqNullSafe(literal(value, kind)) if negated else column == literal(value, kind)
        if op == "!=":
            differs = column != literal(value, kind) if fits else column.isNotNull()
            if self.presence:
                return F.coalesce(differs, F.lit(False)) | self._explicit_null(leaf.path)
            return self._closed(differs, negated)
        if not fits or kind_of_type(kind) in ("list", "map"):
            return F.lit(False)
        want = literal(value, kind)
        return self._closed({">": column > want, ">=": column >= want, "<": column < want, "<=": column <= want}[op], negated)

    def _fits(self, value: Any, kind: T.DataType) -> bool:
        if not comparable(value, kind):
            return False
        if self.strict and isinstance(kind, T.NumericType):
            return isinstance(value, float) == isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType))
        return True

    @staticmethod
    def _closed(condition: Column, negated: bool) -> Column:
        return F.coalesce(condition, F.lit(False)) if negated else condition
