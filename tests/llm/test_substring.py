import hashlib
import random

import numpy as np

from tessera.llm import substring


def brute(rows):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        if d is not None:
            for p in range(len(w) - 49):
                k = tuple(w[p : p + 50])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in split:
        keep = np.ones(len(w), bool)
        if d is not None:
            for p in range(len(w) - 49):
                if first[tuple(w[p : p + 50])] < d:
                    keep[p : p + 50] = False
        text = b" ".join(x for x, k in zip(w, keep) if k)
        out.append((d, len(w), int((~keep).sum()), hashlib.sha256(text).hexdigest()))
    return sorted(out, key=str)


def same(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in substring.drop_repeats(df.select("doc_id", "text")).collect()), key=str)
    want = brute(rows)
    assert got == want
    return sum(r[2] for r in want)


def test_against_all_windows(documents, messy, empty):
    assert same(documents) > 0
    same(messy)
    same(empty)


def test_passages_at_every_alignment(spark):
    draw = random.Random(3)
    word = lambda: f"v{draw.randrange(10**6)}"
    passage = [word() for _ in range(90)]
    texts = []
    for i in range(120):
        size = draw.choice([49, 50, 51, 60, 90])
        at = draw.randrange(91 - size)
        texts.append(" ".join([word() for _ in range(i % 37)] + passage[at : at + size] + [word() for _ in range(draw.randrange(40))]))
    texts += ["same " * 120, "same " * 60, " ".join(["a", "b"] * 70), " ".join(["b", "a"] * 70)]
    order = list(range(len(texts)))
    draw.shuffle(order)
    assert same(spark.createDataFrame([(order[i], t) for i, t in enumerate(texts)], "doc_id long, text string")) > 1000


def test_the_cover_is_one():
    got = {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER}
    assert got == set(range(substring.PERIOD))
    assert substring.ANCHOR + substring.PERIOD - 1 <= substring.WINDOW


def test_key_filter_loses_nothing(spark):
    from tessera.llm.idfilter import maybe_in

    rows, wanted = spark.range(0, 20000, 1, 4).toDF("doc_id"), spark.range(0, 20000, 7).toDF("doc_id")
    got = {r[0] for r in maybe_in(rows, wanted).collect()}
    assert got >= set(range(0, 20000, 7)) and len(got) < 3100
