import math
from collections import Counter, defaultdict

import pytest

from tessera.llm import ngram

TRAIN = ["a b c d", "a b e", "c d a b c", "x y z", "b c e a", ""]
SCORED = [*TRAIN, "x y z x", "a b c", "y z", "a b unknown", "d a b e"]


def whole_model_scores():
    """Scores from dictionaries of every n-gram of the training texts, whatever its count."""
    c1, c2, c3 = Counter(), Counter(), Counter()
    for s in ([*t.split(), None] for t in TRAIN):
        c1.update(s), c2.update(zip(s, s[1:])), c3.update(zip(s, s[1:], s[2:]))
    total, size, d = sum(c1.values()), len(c1), ngram.DISCOUNT
    once, twice = (sum(c == k for c in c1.values()) for k in (1, 2))
    d1 = min(0.9, max(0.1, once / max(1, once + 2 * twice)))
    m2, m3 = defaultdict(float), defaultdict(float)
    for (u, _), c in c2.items():
        m2[u] += (c - d) / c1[u]
    for (u, v, _), c in c3.items():
        m3[u, v] += (c - d) / c2[u, v]
    out = []
    for s in ([*t.split(), None] for t in SCORED):
        score = 0.0
        for j, w in enumerate(s):
            p = (c1[w] - d1) / total if w in c1 else d1 * size / total
            if j > 0:
                p = (max(c2[s[j - 1], w] - d, 0) / c1[s[j - 1]] if s[j - 1] in c1 else 0) + (1 - m2[s[j - 1]]) * p
            if j > 1:
                pair = s[j - 2], s[j - 1]
                p = (max(c3[*pair, w] - d, 0) / c2[pair] if pair in c2 else 0) + (1 - m3[pair]) * p
            score += math.log10(p)
        out.append((len(s), score))
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard_tokens": 4, "vocabulary_shard": 3}])
def test_ngrams_seen_once_are_in_the_model(spark, sizes):
    trie = ngram.train_model(spark.createDataFrame(list(enumerate(TRAIN)), "doc_id long, text string"), **sizes)
    got = {r["doc_id"]: r for r in ngram.score(spark.createDataFrame(list(enumerate(SCORED)), "doc_id long, text string"), trie).collect()}
    for i, (n, score) in enumerate(whole_model_scores()):
        assert got[i]["n_tokens"] == n
        assert -3e-3 * n - 1e-6 <= got[i]["score"] - score <= 1e-6
