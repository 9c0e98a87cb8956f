"""Aggregates with a predicate of their own, group-by and top-n over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.lang import tree as t
from tessera.lang.parser import QueryError
from tessera.plans.predicates import Predicates, resolve


def number(schema: T.StructType, path: str) -> Column:
    """A field as double; null where it is no number, so that it adds nothing."""
    found = resolve(schema, path)
    if found is None:
        return F.lit(None).cast("double")
    column, kind = found
    if isinstance(kind, T.VariantType):
        return F.try_variant_get(column, "$", "double")
    return column.cast("double") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")


def metric_column(schema: T.StructType, metric: t.Metric, strict: bool = False) -> Column:
    """One aggregate: counts are whole, the others double; sums and averages of nothing are 0, extremes null."""
    test = Predicates(schema, strict).compile(metric.where) if metric.where is not None else None
    if metric.func == "count":
        return F.count(F.when(test, F.lit(1)) if test is not None else F.lit(1)).alias(metric.label)
    value = number(schema, metric.field)
    if test is not None:
        value = F.when(test, value)
    out = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[metric.func](value)
    if metric.func in ("sum", "avg"):
        out = F.coalesce(out, F.lit(0.0))
    return out.alias(metric.label)


def group_columns(schema: T.StructType, fields: tuple) -> list[Column]:
    """Grouping columns under the fields' own names; a field that no record has is one group, null."""
    out = []
    for path in fields:
        found = resolve(schema, path)
        column = found[0] if found else F.lit(None).cast("string")
        if found and isinstance(found[1], T.VariantType):
            column = F.try_variant_get(column, "$", "string")
        out.append(column.alias(path))
    return out


def aggregate(df: DataFrame, metrics: tuple, group: tuple = (), strict: bool = False) -> DataFrame:
    columns = [metric_column(df.schema, m, strict) for m in metrics]
    if not group:
        return df.agg(*columns)
    clash = {m.label for m in metrics} & set(group)
    if clash:
        raise QueryError(f"{sorted(clash)[0]} is a group field and a metric; name the metric with AS")
    return df.groupBy(*group_columns(df.schema, group)).agg(*columns)


def take_groups(groups: DataFrame, take: t.Take, group: tuple, metrics: tuple) -> DataFrame:
    """The n groups with the greatest or least metric; ties go to the lesser group key."""
    if take.by is None:
        return groups.limit(take.n)
    label = next((m.label for m in metrics if take.by in (m.label, m.canonical)), None)
    if label is None:
        raise QueryError(f"TAKE BY {take.by}: AGGREGATE has no such metric")
    by = F.col(f"`{label}`")
    keys = [F.col(f"`{g}`").asc_nulls_first() for g in group]
    return groups.orderBy(by.desc_nulls_last() if take.descending else by.asc_nulls_last(), *keys).limit(take.n)
