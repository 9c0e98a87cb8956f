"""Exact top-k by vector similarity: scores are Spark expressions in double precision."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.lang import tree as t
from tessera.lang.parser import QueryError
from tessera.plans.predicates import resolve

SCORE = "_score"
_METRICS = {"cosine": "cosine", "cos": "cosine", "dot": "dot", "inner": "dot", "l2": "l2", "euclidean": "l2"}


def metric_name(name: str) -> str:
    if name.lower() not in _METRICS:
        raise QueryError(f"unknown metric {name}; there are cosine, dot and l2")
    return _METRICS[name.lower()]


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def score(vector: Column, query: Column, metric: str) -> Column:
    """Greater is nearer; l2 is the negative distance. Null where the vector is unusable: null or not finite in a component, or of another length."""
    if metric == "dot":
        value = _dot(vector, query)
    elif metric == "l2":
        gap = F.zip_with(vector, query, lambda x, y: x.cast("double") - y.cast("double"))
        value = -F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x))
    else:
        norms = F.sqrt(_dot(vector, vector)) * F.sqrt(_dot(query, query))
        value = F.when(norms > 0, _dot(vector, query) / norms)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    # Huge components can still overflow to a value that is none.
    return F.when((F.size(vector) == F.size(query)) & finite, F.nanvl(value, F.lit(None).cast("double")))


def _vector(df: DataFrame, field: str) -> Column:
    found = resolve(df.schema, field)
    if found is None or not isinstance(found[1], T.ArrayType) or not isinstance(found[1].elementType, T.NumericType):
        raise QueryError(f"NEAREST: {field} is not a vector field")
    return found[0]


def reference(df: DataFrame, field: str, ref: t.Ref, id_field: str) -> tuple[list[float], Any]:
    """Vector and id of the one record that holds the text in any field."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    ids = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType) and f.name == id_field]
    tests = [F.col(f"`{c}`") == ref.text for c in texts] + [F.col(f"`{c}`").cast("string") == ref.text for c in ids]
    if not tests:
        raise QueryError("REF: the records have no text field")
    test = tests[0]
    for more in tests[1:]:
        test = test | more
    rows = df.filter(test).select(F.col(f"`{id_field}`").alias("id"), _vector(df, field).alias("v")).limit(2).collect()
    if len(rows) != 1:
        raise QueryError(f"REF {ref.text!r} matches {'no record' if not rows else 'more than one record'}")
    if rows[0]["v"] is None:
        raise QueryError(f"REF {ref.text!r} has no vector")
    return list(rows[0]["v"]), rows[0]["id"]


def nearest(df: DataFrame, step: t.Nearest, id_field: str) -> DataFrame:
    """The k records nearest to the query, ties by id. The scores are in ``_score``."""
    metric = metric_name(step.metric)
    if not isinstance(step.k, int) or step.k < 0:
        raise QueryError("NEAREST: k is a whole number of 0 or more")
    vector = _vector(df, step.field)
    query = step.query
    if isinstance(query, t.Ref):
        query, own = reference(df, step.field, query, id_field)
        df = df.filter(F.col(f"`{id_field}`") != F.lit(own))
    if not isinstance(query, (list, tuple)) or not query or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in query):
        raise QueryError("NEAREST: the query is a list of numbers")
    wanted = F.array(*[F.lit(float(x)) for x in query])
    scored = df.withColumn(SCORE, score(vector, wanted, metric))
    # Unusable vectors sort last and go after the limit: a filter before it would compute every score twice.
    return scored.orderBy(F.col(SCORE).desc_nulls_last(), F.col(f"`{id_field}`").asc()).limit(step.k).filter(F.col(SCORE).isNotNull())


def nearest_per_key(df: DataFrame, key: str, field: str, query: list[float], k: int, id_field: str, metric: str = "cosine") -> DataFrame:
    """The k nearest records of each key.

    Spark keeps the k best of each key in every task before it moves rows (window group limit).
    """
    wanted = F.array(*[F.lit(float(x)) for x in query])
    scored = df.withColumn(SCORE, score(_vector(df, field), wanted, metric_name(metric)))
    order = Window.partitionBy(f"`{key}`").orderBy(F.col(SCORE).desc_nulls_last(), F.col(f"`{id_field}`").asc())
    return scored.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).filter(F.col(SCORE).isNotNull())
