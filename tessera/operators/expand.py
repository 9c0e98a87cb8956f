"""FOLLOW, PULL and FETCH: expansion by values, by cluster key, and envelopes over several datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import kind_of_type
from tessera.lang.parser import QueryError
from tessera.plans.predicates import resolve

#: Link steps of a PULL never exceed this, whatever the statement says.
DEEPEST = 10


def follow(source: DataFrame, field: str, target: DataFrame, on: str) -> DataFrame:
    """Records of ``target`` whose ``on`` is a value of ``field`` in ``source``; each record once.

    A left semi join: the distinct values of the source are its build side, and Spark chooses by
    their size at run time whether they are broadcast or shuffled.  A link field holds the ids of all its targets.
    """
    a, b = resolve(source.schema, field), resolve(target.schema, on)
    if a is None or b is None or kind_of_type(a[1]) != kind_of_type(b[1]):
        return target.limit(0)
    value = F.explode(F.split(a[0], ",")) if field.startswith("_link_") else a[0]
    wanted = source.select(value.alias("_wanted")).filter(F.col("_wanted").isNotNull()).distinct()
    return target.join(wanted, b[0] == F.col("_wanted"), "left_semi")


def pull(roots: DataFrame, base: DataFrame, keys: list[str], only: str | None = None) -> DataFrame:
    """Records of ``base`` that share a cluster key with a root, filtered by ``_type`` if wanted."""
    for key in keys:
        if key not in base.columns or key not in roots.columns:
            raise QueryError(f"PULL needs the cluster key {key}; declare it with GRAVITY BY")
    wanted = roots.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]).filter(F.col("_k0").isNotNull()).distinct()
    same = F.lit(True)
    for i, key in enumerate(keys):
        # The bucket is never null, and plain equality lets Spark read only the wanted buckets.
        same = same & (base[f"`{key}`"].eqNullSafe(wanted[f"_k{i}"]) if i and key != "_bucket" else base[f"`{key}`"] == wanted[f"_k{i}"])
    out = base.join(wanted, same, "left_semi")
    return only_type(out, only)


def only_type(df: DataFrame, only: str | None) -> DataFrame:
    if only is None:
        return df
    return df.filter(F.col("_type") == only) if "_type" in df.columns else df.limit(0)


def linked_ids(roots: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(_lid) reached from the roots by at most ``depth`` link steps, roots included.

    ``edges`` is (src, dst).  Each round joins the newest ids and takes off those already seen.
    """
    seen = new = roots.select("_lid").distinct()
    for _ in range(min(depth, DEEPEST)):
        new = edges.join(new, edges["src"] == new["_lid"], "left_semi").select(F.col("dst").alias("_lid")).distinct().join(seen, "_lid", "left_anti")
        seen = seen.unionByName(new).checkpoint() if seen.sparkSession.sparkContext.getCheckpointDir() else seen.unionByName(new)
    return seen.distinct()


def fetch(sections: list[tuple[str, DataFrame]], most: int) -> DataFrame:
    """One envelope row; each field is the list of a dataset's matching records. More than ``most`` in one list is an error."""
    out = None
    for name, df in sections:
        held = F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
        row = df.limit(most + 1).agg(held.alias("held"), F.count(F.lit(1)).alias("n"))
        message = F.lit(f"FETCH: section {name} has more than {most} records; use SCAN")
        row = row.select(F.when(F.col("n") > most, F.raise_error(message).cast(row.schema["held"].dataType)).otherwise(F.col("held")).alias(name))
        # Each side is one aggregated row, so the product is one row.
        out = row if out is None else out.crossJoin(row)
    if out is None:
        raise QueryError("FETCH needs a dataset")
    return out
