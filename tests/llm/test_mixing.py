import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing


def mixture(spark, tokens, **options):
    """(plan, weights, passes) of a dictionary of sources."""
    totals = spark.createDataFrame(list(tokens.items()), "s string, tokens long")
    plan = mixing.temperature(totals, **options)
    rows = totals.select("s", plan.weight(F.col("tokens").cast("double")).alias("w"), plan.passes(F.col("tokens").cast("double")).alias("p")).collect()
    return plan, {r["s"]: r["w"] for r in rows}, {r["s"]: r["p"] for r in rows}


def test_temperature_meets_the_target(spark):
    tokens = {f"s{i}": 100 * (i + 1) ** 2 for i in range(12)}
    plan, weights, passes = mixture(spark, tokens, target_entropy=0.93, max_passes=50.0)
    entropy = -sum(w * math.log(w) for w in weights.values())
    assert sum(weights.values()) == pytest.approx(1.0)
    assert entropy == pytest.approx(0.93 * math.log(12), abs=1e-6)
    assert min(passes.values()) == 1.0
    tight, _, passes = mixture(spark, tokens, target_entropy=0.99, max_passes=3.0)
    assert max(passes.values()) == pytest.approx(3.0, abs=1e-6) and tight.alpha > plan.alpha
    assert mixture(spark, {"a": 5, "b": 5})[0].alpha == 1.0
    assert mixture(spark, {"a": 1})[2] == {"a": 1.0} and mixture(spark, {})[2] == {}
    assert mixture(spark, {"a": 100, "b": 100}, budget=100.0)[2] == {"a": 0.5, "b": 0.5}


def test_many_sources_stay_in_the_cluster(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # what remains would be forced
    try:
        rows = spark.range(250_000).selectExpr("id AS doc_id", "concat('a b c ', id) AS text", "CASE WHEN id % 5 = 0 THEN 'hot' ELSE concat('site', id) END AS source")
        out = mixing.mix_sources(rows)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
        assert out.select("row.doc_id").distinct().count() == 250_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def readings(df, **options):
    return mixing.mix_sources(df, **options).selectExpr("row.doc_id AS doc_id", "row.text AS text", "row.source AS source", "n_tokens", "epoch", "block").collect()


def skewed(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 17)), "hot" if i % 10 < 7 else f"s{i % 10}") for i in range(2000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("options", [{}, {"target_entropy": 0.99, "max_passes": 5.0}, {"budget": 4000.0, "max_passes": 9.0}])
def test_budgets_of_sources_are_met(spark, options):
    df = skewed(spark)
    got = readings(df, **options)
    tokens, longest = Counter(), Counter()
    for r in mixing.counted_rows(df).select("row.source", "n_tokens").collect():
        n = r["n_tokens"]
        tokens[r["source"]] += n
        longest[r["source"]] = max(longest[r["source"]], n)
    passes_of = mixture(spark, dict(tokens), **options)[2]
    read = Counter()
    for r in got:
        read[r["source"]] += r["n_tokens"]
    for s, n in tokens.items():
        assert passes_of[s] * n - 2 * longest[s] - 1e-6 <= read[s] <= passes_of[s] * n + 1e-6
    per = Counter((r["doc_id"], r["epoch"]) for r in got)
    assert max(per.values()) == 1
    passes = defaultdict(int)
    for d, _ in per:
        passes[d] += 1
    if "budget" not in options:
        assert len(passes) == 2000
    again = readings(df, **options)
    assert Counter(got) == Counter(again)


def test_the_partial_pass_is_a_prefix_of_the_pass_s_order(spark):
    df = skewed(spark)
    got = {(r["doc_id"], r["epoch"]) for r in readings(df)}
    counted = mixing.counted_rows(df).selectExpr("row.doc_id", "row.source", "h", "n_tokens")
    tokens = {r["source"]: r["t"] for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    passes = mixture(spark, tokens)[2]
    for epoch in (0, 1):
        keyed = counted.withColumn("k", mixing._uniform(F.lit(mixing.SEED), F.lit(epoch), F.col("doc_id"), F.col("h"))).collect()
        for source in tokens:
            room = (passes[source] - epoch) * tokens[source]
            if room <= 0:
                continue
            want, used = set(), 0
            for r in sorted((r for r in keyed if r["source"] == source), key=lambda r: r["k"]):
                used += r["n_tokens"]
                if used > room + 1e-9:
                    break
                want.add((r["doc_id"], epoch))
            assert want == {(d, e) for d, e in got if e == epoch and any(r["doc_id"] == d and r["source"] == source for r in keyed)}


def test_messy_and_empty(spark, messy, empty, sf):
    out = mixing.mixing_stage(spark, messy, sf)
    assert out.columns == messy.columns
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in messy.collect()}
    assert mixing.mixing_stage(spark, empty, sf).count() == 0
