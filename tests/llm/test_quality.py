import re

import duckdb
import pytest

from tessera.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    spans = {}
    for p in range(len(words) - 4):
        spans.setdefault(tuple(words[p : p + 5]), []).append(p)
    again = {p + j for v in spans.values() if len(v) > 1 for p in v for j in range(5)}
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed


def figures(df):
    x = quality.with_quality(df, into="f").select("doc_id", "text", "f.*").collect()
    return [(r["doc_id"], r["text"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]), r["kept"]) for r in x]


def test_base_figures(documents, messy, spark):
    hard = ["a b c d e a b c d e", "a b c d e f a b c d e", "x " * 40, "a\na\n a\n\n\n", "a b c d e", "a b c d", "l1\nl1\nl2", "a b c d e b c d e a b c d e f g h i j k l m n o p q r s t"]
    more = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    for df in (documents, messy.select("doc_id", "text"), more):
        for doc_id, text, got, kept in figures(df):
            assert got == base(text), (doc_id, text[:80] if text else text)
            assert not (kept and got[-1])


def test_base_figures_of_random_texts(spark):
    import random

    draw = random.Random(11)
    texts = ["".join(draw.choice(["a", "b", "c", " ", " ", "\n", "\t", "#", "é"]) for _ in range(draw.randrange(160))) for _ in range(600)]
    for doc_id, text, got, _ in figures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")):
        assert got == base(text), (doc_id, text)


def test_sql_says_the_same(spark, sf):
    got = quality.op2_quality_rules(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(quality.ORACLE_SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert (got[sorted(got.columns)].astype(str).values == want[sorted(want.columns)].astype(str).values).all()


def test_plan_is_a_scan_and_projections(spark, sf):
    plan = quality.op2_quality_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Join", plan)


@pytest.mark.parametrize(
    "text, kept",
    [
        ("The cat sat on the mat and the dog lay by the door of the old house.", True),
        ("BUY!! NOW!! THE!! BEST!! DEAL!! OF!! THE!! YEAR!! IS!! HERE!! TODAY!!", False),
        ("one | two | three | four | five | six | seven | eight | nine | ten | eleven", False),
        ("word### other*** more&&& of%%% the$$$ same### thing*** here&&& and%%% there$$$", False),
        ("too few words here", False),
        ("zq " + " ".join(f"xk{i}" for i in range(60)), False),
    ],
)
def test_verdicts(spark, text, kept):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality.with_quality(df).first()["quality_figures"]["kept"] is kept


def test_stage_keeps_rows_whole(messy, empty):
    assert quality.keep_good(messy).schema == messy.schema
    assert quality.keep_good(empty).count() == 0
    good = {r["doc_id"] for r in quality.with_quality(messy, into="f").filter("f.kept").collect()}
    assert {r["doc_id"] for r in quality.keep_good(messy).collect()} == good
    with pytest.raises(ValueError, match="into="):
        quality.with_quality(messy)
