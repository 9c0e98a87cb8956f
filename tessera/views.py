"""Materialized views: definitions, states that merge, and the test whether a view can answer a query.

An aggregate view's state is additive: a part per write, with negative counts and sums for rows that left,
merged on read by one group-by.  Extremes cannot be subtracted; when rows leave, the touched groups are
computed anew from the base.  A covering view keeps the columns it needs of each matching record; parts carry
their number, and a record is alive if no later part took its id out.
"""

from __future__ import annotations

from dataclasses import fields, is_dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.lang import forms
from tessera.lang import tree as t
from tessera.lang.parser import QueryError
from tessera.plans.aggregates import group_columns, number
from tessera.plans.predicates import Predicates, resolve

#: A view with so many parts is merged into one by the next write.
MERGE_AT = 8


# --- trees as JSON ---


def encode(node: Any) -> Any:
    if is_dataclass(node):
        return {"_": type(node).__name__, **{f.name: encode(getattr(node, f.name)) for f in fields(node)}}
    if isinstance(node, (tuple, list)):
        return [encode(x) for x in node]
    return node


def decode(node: Any) -> Any:
    if isinstance(node, dict):
        return getattr(t, node["_"])(**{k: decode(v) for k, v in node.items() if k != "_"})
    return tuple(decode(x) for x in node) if isinstance(node, list) else node


# --- aggregate views ---


def is_aggregate(view: t.CreateView) -> bool:
    return bool(view.metrics)


def has_extremes(view: t.CreateView) -> bool:
    return any(m.func in ("min", "max") for m in view.metrics)


def state_rows(view: t.CreateView, df: DataFrame, sign: int = 1) -> DataFrame:
    """State of the rows of ``df`` that the view covers: ``_n`` and per metric a count and a sum or an extreme."""
    covered = df.filter(Predicates(df.schema).compile(view.where))
    columns = [(F.count(F.lit(1)) * sign).alias("_n")]
    for i, m in enumerate(view.metrics):
        test = Predicates(df.schema).compile(m.where) if m.where is not None else F.lit(True)
        if m.func == "count":
            columns.append((F.count(F.when(test, F.lit(1))) * sign).alias(f"c{i}"))
            continue
        value = F.when(test, number(df.schema, m.field))
        if m.func in ("sum", "avg"):
            columns += [(F.count(value) * sign).alias(f"c{i}"), (F.coalesce(F.sum(value), F.lit(0.0)) * sign).alias(f"s{i}")]
        else:
            columns.append({"min": F.min, "max": F.max}[m.func](value).alias(f"x{i}"))
    return covered.groupBy(*group_columns(df.schema, view.group)).agg(*columns)


def merge_states(view: t.CreateView, states: DataFrame) -> DataFrame:
    columns = [F.sum("_n").alias("_n")]
    for i, m in enumerate(view.metrics):
        if m.func in ("min", "max"):
            columns.append({"min": F.min, "max": F.max}[m.func](f"x{i}").alias(f"x{i}"))
        else:
            columns.append(F.sum(f"c{i}").alias(f"c{i}"))
            if m.func != "count":
                columns.append(F.sum(f"s{i}").alias(f"s{i}"))
    return states.groupBy(*[f"`{g}`" for g in view.group]).agg(*columns)


def live_groups(view: t.CreateView, state: DataFrame) -> DataFrame:
    """Groups that still have a record; a view without groups always has its one row."""
    return state.filter("_n > 0") if view.group else state


def state_metrics(view: t.CreateView, state: DataFrame, wanted: tuple, keep: list[str] | None = None) -> DataFrame:
    """The wanted metrics, under their own labels, from a merged state, beside its groups or the columns to keep."""
    have = {_signature(m): i for i, m in enumerate(view.metrics)}
    columns = [F.col(f"`{g}`") for g in (view.group if keep is None else keep)]
    for m in wanted:
        i = have[_signature(m)]
        if m.func == "count":
            value = F.coalesce(F.col(f"c{i}"), F.lit(0)).cast("long")
        elif m.func == "sum":
            # Nothing left: exactly 0, whatever rounding the subtraction left.
            value = F.when(F.col(f"c{i}") > 0, F.col(f"s{i}")).otherwise(F.lit(0.0))
        elif m.func == "avg":
            value = F.when(F.col(f"c{i}") > 0, F.col(f"s{i}") / F.col(f"c{i}")).otherwise(F.lit(0.0))
        else:
            value = F.col(f"x{i}")
        columns.append(value.alias(m.label))
    return state.select(*columns)


def _signature(m: t.Metric) -> tuple:
    return m.func, m.field, forms.canonical(m.where)


# --- covering views ---


def covering_fields(view: t.CreateView, pins: list[str], schema_names: list[str]) -> list[str]:
    """Top-level columns that a covering view stores: whole records, or with EMBED the named fields and what the view itself needs."""
    if not view.embed:
        return list(schema_names)
    wanted = [*view.embed, *pins, *([view.order.split(".")[0]] if view.order else []), "_lid", "_type", "_nulls"]
    return [n for n in dict.fromkeys(wanted) if n in schema_names]


def in_order(view: t.CreateView, df: DataFrame) -> DataFrame:
    """Rows of a part in the view's order, so that a test of the order field skips files, row groups and pages."""
    found = resolve(df.schema, view.order) if view.order else None
    if found is None or not isinstance(found[1], T.AtomicType):
        return df
    return df.orderBy(found[0].desc_nulls_last() if view.descending else found[0].asc_nulls_last())


# --- states in the order of a metric ---

#: For a take of so many groups at most, the metric's value that its groups reach is noted when the state is written.
RANKS = (64, 512, 4096, 10_000)
METRIC = "_metric"


def order_metric(view: t.CreateView) -> t.Metric | None:
    """The metric that an aggregate view is ordered by."""
    return next((m for m in view.metrics if view.group and view.order in (m.label, m.canonical)), None)


def with_metric(view: t.CreateView, state: DataFrame) -> DataFrame:
    """A merged state with the value of the metric that the view is ordered by, in that order."""
    m = order_metric(view)
    value = state_metrics(view, state.select("*"), (m,), keep=state.columns).withColumnRenamed(m.label, METRIC)
    key = F.col(METRIC).cast("double")
    return value.withColumn(METRIC, key).orderBy(key.desc_nulls_last() if view.descending else key.asc_nulls_last())


def rank_values(view: t.CreateView, ordered: DataFrame) -> list[list]:
    """(rank, value): the metric of the group at each of ``RANKS``; as many rows are read as the greatest of them."""
    key = F.col(METRIC)
    top = ordered.filter(key.isNotNull()).select(key).orderBy(key.desc() if view.descending else key.asc()).limit(RANKS[-1]).collect()
    return [[n, top[n - 1][0]] for n in RANKS if n <= len(top)]


def first_groups(view: t.CreateView, entry: dict, state: DataFrame, take: Any) -> DataFrame:
    """The groups that a take can need, if the view is one state in the order of the same metric: the others are skipped by statistics."""
    m, parts = order_metric(view), entry["parts"]
    if m is None or len(parts) != 1 or take.by not in (m.label, m.canonical) or bool(take.descending) != bool(view.descending):
        return state
    value = next((v for n, v in parts[0].get("ranks", []) if n >= take.n), None)
    if value is None:
        return state
    return state.filter(F.col(METRIC) >= value if view.descending else F.col(METRIC) <= value)


# --- routing ---


def answers_aggregate(view: t.CreateView, dataset: str, where: Any, group: tuple, metrics: tuple) -> list | None:
    """The conditions on group fields left to test if the view can answer exactly, else None."""
    if view.dataset != dataset or not is_aggregate(view) or tuple(view.group) != tuple(group):
        return None
    if not {_signature(m) for m in metrics} <= {_signature(m) for m in view.metrics}:
        return None
    left = _rest(view.where, where)
    if left is None:
        return None
    # What is left must be about whole groups: equality on a group field.
    fits = all(isinstance(c, t.Leaf) and c.op == "=" and c.path in group and c.value is not None for c in left)
    return left if fits else None


def answers_records(view: t.CreateView, scan: t.Scan) -> bool:
    """Whether a covering view holds whole records of all that a scan can return, and serves it better than the base: by its
    own conditions, which the scan must repeat, or by its order, which the scan must ask for or test."""
    if view.dataset != scan.dataset or is_aggregate(view) or view.embed or _rest(view.where, scan.where) is None:
        return False
    tested = any(isinstance(c, t.Leaf) and c.path == view.order and c.op in ("=", "<", "<=", ">", ">=") for c in forms.conjuncts(scan.where))
    return view.where is not None or tested or (scan.order is not None and scan.order == view.order)


def _rest(inner: Any, outer: Any) -> list | None:
    """Conjuncts of ``outer`` beyond those of ``inner``, if it has all of them in the same form."""
    need = [forms.canonical(c) for c in forms.conjuncts(inner)]
    have = forms.conjuncts(outer)
    marks = [forms.canonical(c) for c in have]
    if not set(need) <= set(marks):
        return None
    return [c for c, mark in zip(have, marks, strict=True) if mark not in need]


def specificity(view: t.CreateView) -> int:
    return len(forms.conjuncts(view.where))


def describe(name: str, entry: dict) -> dict:
    view = decode(entry["definition"])
    kind = "aggregate" if is_aggregate(view) else "covering"
    order = f"{view.order} {'DESC' if view.descending else 'ASC'}" if view.order else None
    return {"name": name, "dataset": view.dataset, "kind": kind, "order_by": order, "conditions": len(forms.conjuncts(view.where)), "parts": len(entry["parts"]), "stale": entry["stale"]}


def read_state(spark: SparkSession, view: t.CreateView, entry: dict) -> DataFrame:
    """The merged state of an aggregate view, or the live rows of a covering one."""
    if is_aggregate(view):
        parts = spark.read.parquet(*[p["path"] for p in entry["parts"]])
        if len(entry["parts"]) == 1:
            return live_groups(view, parts)  # one part is merged already
        return live_groups(view, merge_states(view, parts))
    kept, gone = None, None
    for i, part in enumerate(entry["parts"]):
        df = spark.read.parquet(part["path"])
        if part["gone"]:
            dead = df.select("_lid", F.lit(i).alias("_gone"))
            gone = dead if gone is None else gone.unionByName(dead)
        else:
            rows = df.withColumn("_part", F.lit(i))
            kept = rows if kept is None else kept.unionByName(rows, allowMissingColumns=True)
    if kept is None:
        raise QueryError("the view has no part")
    if gone is not None:
        last = gone.groupBy("_lid").agg(F.max("_gone").alias("_gone"))
        kept = kept.join(last, "_lid", "left").filter(F.col("_gone").isNull() | (F.col("_gone") < F.col("_part"))).drop("_gone")
    return kept.drop("_part")
