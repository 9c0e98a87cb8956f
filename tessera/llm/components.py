"""Connected components of an edge table, by contraction in the cluster.

Each round sends every vertex to the least of itself and its neighbours, rewrites the edges by
that map and drops those that became loops.  Maps and edges are tables in the shared folder;
nothing is gathered on the driver, and tables that no later round reads are deleted.

Defined cases: loops, repeated and reversed edges are allowed; edges with a null end are ignored; without edges there
are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex of ``edges`` (a, b); the component is its least vertex.

    Loops, repeated and reversed edges are allowed; edges with a null end are ignored.
    """
    rest = materialize(_distinct(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))), "edges")
    found = None
    while rest.take(1):
        ends = rest.select(F.col("a").alias("vertex"), F.col("b").alias("other")).unionAll(rest.select(F.col("b"), F.col("a")))
        step = materialize(ends.groupBy("vertex").agg(F.min("other").alias("m")).select("vertex", F.least("vertex", "m").alias("parent")), "parents")
        to_a = step.select(F.col("vertex").alias("a"), F.col("parent").alias("pa"))
        to_b = step.select(F.col("vertex").alias("b"), F.col("parent").alias("pb"))
        done, rest = rest, materialize(_distinct(rest.join(to_a, "a").join(to_b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "edges")
        if found is None:
            found = step.withColumnRenamed("parent", "component")
        else:
            moved = step.select(F.col("vertex").alias("component"), F.col("parent"))
            before, found = found, materialize(found.join(moved, "component", "left").select("vertex", F.coalesce("parent", "component").alias("component")), "components")
            discard(before)
            discard(step)
        discard(done)
    if found is None:
        found = edges.sparkSession.createDataFrame([], "vertex long, component long")
    return found


def _distinct(edges: DataFrame) -> DataFrame:
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return edges.filter(F.col("a") != F.col("b")).select(low.alias("a"), high.alias("b")).distinct()
