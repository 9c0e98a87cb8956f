import math
import zlib
from collections import Counter, defaultdict

import pytest

from tessera.llm import ngram

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
END = object()


def tokens(text):
    return [*(text or "").encode().translate(LOWER).split(), END]


def brute(rows):
    """(n_tokens, n_known, train tokens, base score, score) by row, from dictionaries."""
    sequences = [tokens(t) for _, t in rows]
    train = [s for (i, _), s in zip(rows, sequences) if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for s in train:
        c1.update(s), c2.update(zip(s, s[1:])), c3.update(zip(s, s[1:], s[2:]))
    total, size = sum(c1.values()), len(c1)
    once, twice = (sum(c == k for c in c1.values()) for k in (1, 2))
    d1, d = min(0.9, max(0.1, once / max(1, once + 2 * twice))), ngram.DISCOUNT
    k2, k3 = c2, c3
    m2, m3 = defaultdict(float), defaultdict(float)
    for (u, v), c in k2.items():
        m2[u] += (c - d) / c1[u]
    for (u, v, w), c in k3.items():
        m3[u, v] += (c - d) / c2[u, v]
    out = []
    for s in sequences:
        base = sum(math.log10((c1[w] + 1) / (total + size + 1)) for w in s)
        score = 0.0
        for j, w in enumerate(s):
            p = 1.0 if not total else (c1[w] - d1) / total if w in c1 else d1 * size / total
            if j > 0:
                u = s[j - 1]
                p = ((k2[u, w] - d) / c1[u] if (u, w) in k2 else 0) + (1 - m2[u]) * p
            if j > 1:
                a = s[j - 2]
                p = ((k3[a, u, w] - d) / c2[a, u] if (a, u, w) in k3 else 0) + (1 - m3[a, u]) * p
            score += math.log10(p)
        out.append((len(s), sum(w in c1 for w in s), total, base, score))
    return out


def check(docs, **sizes):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    trie = ngram.train_model(docs.filter(~ngram.held_out()), **sizes)
    got = ngram.score(docs, trie).collect()
    assert len(got) == len(rows)
    want = sorted(((-1 if i is None else i), *w) for (i, _), w in zip(rows, brute(rows)))
    for g, w in zip(sorted(got, key=lambda r: (-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["base_score"])), want):
        assert (g["n_tokens"], g["n_known"], trie.vocabulary.tokens) == w[1:4]
        assert g["base_score"] == pytest.approx(w[4], abs=1e-6)
        # Steps of 1/1024 of a decade, rounded down, for each of at most five factors.
        assert -3e-3 * w[1] - 1e-6 <= g["score"] - w[5] <= 1e-6
    return got


def test_against_dictionaries(documents):
    got = check(documents)
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2]
    assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)


def test_many_small_shards_cut_frequent_contexts(documents):
    check(documents, shard_tokens=3000, vocabulary_shard=2000)


def test_a_frequent_pair_is_cut_by_the_third_word(spark):
    import random

    draw = random.Random(3)
    rows = [(i, " ".join(f"hot pair w{draw.randrange(40_000)}" for _ in range(100))) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    trie = ngram.train_model(df, shard_tokens=3000, vocabulary_shard=5000)
    assert trie.vocabulary.tokens == 301_000 and 90 < len(trie.triples) < 110
    assert 0 < trie.triples.max() <= 2 * 3000
    assert len(trie.cut_pair)
    check(df.limit(150), shard_tokens=500, vocabulary_shard=2000)
    check(df.limit(40), shard_tokens=3)


def test_messy_and_empty(messy, empty):
    check(messy)
    trie = ngram.train_model(empty)
    assert ngram.score(empty, trie).count() == 0
    assert {(r["score"], r["base_score"]) for r in ngram.score(messy, trie).collect()} == {(0.0, 0.0)}


def test_probabilities_of_a_context_sum_to_one_at_most(spark):
    rows = [(i, t) for i, t in enumerate(["a b c", "a b d", "a b c", "b c a", "c a b"] * 3)]
    trie = ngram.train_model(spark.createDataFrame(rows, "doc_id long, text string"))
    words = ["a", "b", "c", "d", "unknownword"]
    for context in ("a b", "b c", "d a", "zz a"):
        full = [f"{context} {w}" for w in words]
        got = {r["doc_id"]: r["score"] for r in ngram.score(spark.createDataFrame(list(enumerate(full + [context])), "doc_id long, text string"), trie).collect()}
        # log p(context w end) - log p(context end) contains p(w | context); compare through single-word extensions
        assert all(v <= 1e-9 for v in got.values())


def test_query_columns(spark, sf):
    df = ngram.op1_lm_score(spark, sf)
    assert df.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert df.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
