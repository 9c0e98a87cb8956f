import os
import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import pytest
from tests_llm_help import near_brute  # noqa: I001

from pyspark.sql import functions as F

REPO = Path(__file__).resolve().parent.parent.parent


def test_stages_follow_each_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), "test-stage")
        assert docs.columns == columns and docs.count() > 0, name
        if name == "n-gram Jaccard join":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {r["doc_id"] for r in docs.collect()} == {c for _, c, _ in near_brute(rows)}
        if name in ("line dedup", "source mixing"):
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def test_messy_rows_pass_every_stage(spark, messy, empty, sf):
    for df in (messy, empty):
        docs = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == df.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_the_rest_works_without_these_folders(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(*gone, ".git", "__pycache__", ".*"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=clean, check=True, timeout=120)


def test_nothing_else_imports_this_subpackage():
    for path in (REPO / "tessera").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "tessera.llm" not in path.read_text(), path
