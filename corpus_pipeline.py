"""From raw documents to packed training sequences: five operators of ``tessera.llm`` in a row.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return
the columns of ``documents``.  :func:`run` writes each stage's result as Parquet in the shared folder and
reads it back, so a lost executor costs no more than the stage it was in.

Defined cases, beyond those that each operator's module states: a null or empty text fails the quality rules and goes; nulls in
other columns pass through, a null ``source`` being a source of its own and a null ``doc_id`` a document like others; a very long
text is judged, compared and encoded whole and cut into pieces of 4096 tokens by the last stage alone; of repeated rows one stays
after the Jaccard join; of tied documents the least ``doc_id`` stays; an empty table gives no pieces; further columns, whatever their names,
pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.jaccard import near_stage
from tessera.llm.lines import line_stage
from tessera.llm.mixing import mixing_stage
from tessera.llm.packing import pack_documents
from tessera.llm.quality import quality_stage
from tessera.llm.store import materialize


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every reading with their places in sequences of 4096 tokens; a document that is read twice is packed twice."""
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Hash orders, MinHash and the configuration program have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
