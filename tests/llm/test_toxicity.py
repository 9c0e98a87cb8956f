import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import toxicity
from tessera.llm.words import each_slice

INSULTS = ["blast", "grumbles", "zorkish", "zorkable"]


def corpus(n, seed=0):
    draw = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    texts, labels = [], []
    for i in range(n):
        text = list(draw.choice(words, draw.integers(5, 60)))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(draw.integers(1, 5)):
                text.insert(draw.integers(0, len(text)), draw.choice(["blast", "Grumbles", f"zorki{draw.integers(90)}"]))
        texts.append(" ".join(text))
        labels.append(int(toxic))
    return texts, np.array(labels)


def learn(spark, texts, labels):
    df = spark.createDataFrame([(i, t, int(y)) for i, (t, y) in enumerate(zip(texts, labels))], "doc_id long, text string, toxic int")
    return toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))


@pytest.fixture(scope="module")
def model(spark):
    return learn(spark, *corpus(1600))


def test_the_gradient_is_that_of_the_likelihood():
    draw = np.random.default_rng(4)
    steps, batch, size = 7, 5, 6
    slots = draw.integers(0, size + 1, (steps, batch, 3))
    label = draw.integers(0, 2, (steps, batch))
    weight = (np.arange(steps)[:, None] < np.array([7, 4, 1, 6, 7])[None, :]).astype(float)
    theta = draw.normal(size=size + 5) * 0.7

    def brute(x):
        """Sums over all labellings of each stretch."""
        total, emit = 0.0, np.append(x[:size], 0.0)
        for k in range(batch):
            n = int(weight[:, k].sum())
            score = emit[slots[:n, k]].sum(axis=1) + x[size]
            value = lambda y: sum(score[t] * y[t] for t in range(n)) + sum(x[size + 1 + 2 * y[t] + y[t + 1]] for t in range(n - 1))  # noqa: B023, E731
            ways = [[m >> t & 1 for t in range(n)] for m in range(1 << n)]
            total += value(label[:n, k].tolist()) - np.log(sum(np.exp(value(y)) for y in ways))
        return total

    got, gradient = toxicity.likelihood(theta, slots, label, weight)
    assert got == pytest.approx(brute(theta), abs=1e-9)
    for i in range(len(theta)):
        step = np.zeros(len(theta))
        step[i] = 1e-5
        assert gradient[i] == pytest.approx((brute(theta + step) - brute(theta - step)) / 2e-5, abs=1e-6)


def test_held_out_accuracy(model):
    texts, labels = corpus(600, seed=9)
    best, total = (np.concatenate(x) for x in zip(*[toxicity.document_evidence(model, w)[:2] for _, _, w in each_slice(pa.array(texts), lower=True)]))
    assert ((model.score(best, total) >= toxicity.DECISION) == labels).mean() > 0.98


def test_marginals_equal_token_by_token_sums(model):
    texts = ["w1 blast w2 w3 w4 w5 blast blast w6", "blast", "w1", "", "w1 " * 300 + "zorki5 " + "w2 " * 300 + "grumbles", "blast " * 50]
    for _, _, words in each_slice(pa.array(texts), lower=True):
        *_, token, got = toxicity.document_evidence(model, words)
        known, weight = model.emissions(toxicity.token_features(words))
        move, at = np.exp(model.moves), 0
        for d in range(words.n_docs):
            here = np.arange(words.first[d], words.first[d + 1])
            if not len(here):
                continue
            potential = np.stack([np.ones(len(here)), np.exp(model.bias + weight[here])], axis=1)
            left, right = np.zeros((len(here), 2)), np.ones((len(here), 2))
            for t in range(len(here)):
                now = (np.array([1.0, 0.0]) if t == 0 else left[t - 1]) @ move * potential[t]
                left[t] = now / now.sum()
            for t in range(len(here) - 2, -1, -1):
                now = (potential[t + 1] * right[t + 1]) @ move.T
                right[t] = now / now.sum()
            p = (left * right)[:, 1] / (left * right).sum(axis=1)
            want = p[known[here]]
            assert np.allclose(got[at : at + len(want)], want, atol=1e-9)
            at += len(want)
        assert at == len(token)


def test_spans_are_byte_offsets(spark, model):
    df = spark.createDataFrame([(1, "é w1 BLAST w2"), (2, "w3 w4"), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r["spans"] for r in toxicity.tag(df, model).collect()}
    assert [("é w1 BLAST w2".encode()[s["start"] : s["end"]]) for s in rows[1]] == [b"BLAST"]
    assert rows[2] == [] and rows[3] == []


def test_messy_and_without_labels(messy, empty, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    for labels in (none, odd):
        model = toxicity.train(messy, labels)
        rows = toxicity.tag(messy, model).collect()
        assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.tag(empty, toxicity.train(empty, none)).count() == 0


def test_query_and_folds(spark, sf):
    import zlib

    rows = toxicity.op5_toxicity(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert len(rows) == 200
