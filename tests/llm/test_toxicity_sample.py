from collections import Counter

import numpy as np

from tessera.llm import toxicity
from tessera.llm.words import each_slice


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_features_are_counted_over_all_labelled_documents(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "COUNTED", 50)
    rows = [(i, f"w{i % 5} blast w{i % 3}" if i % 4 == 0 else f"w{i % 5} w{i % 3} other", int(i % 4 == 0)) for i in range(400)]
    got = {r["feature"]: (r["total"], r["hits"]) for r in toxicity.feature_counts(labelled(spark, rows).select("text", "toxic")).collect()}
    total, hits = Counter(), Counter()
    for _, text, toxic in rows:
        for word in set(text.split()):
            total[word] += 1
            hits[word] += toxic
    import pyarrow as pa

    for word in total:
        for *_, words in each_slice(pa.array([word])):
            assert got[int(words.hashes().view(np.int64)[0])] == (total[word], hits[word])


def test_long_documents_are_learnt_from(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 200)
    monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", 200)
    plain = " ".join(f"w{i % 300}" for i in range(30_000))
    rows = [(i, plain + (" blast" if i % 2 else " harmless"), i % 2) for i in range(60)]
    df = labelled(spark, rows)
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = {r["doc_id"]: r["score"] for r in toxicity.tag(df.select("doc_id", "text"), model).collect()}
    assert all((got[i] >= toxicity.DECISION) == (i % 2 == 1) for i in got)


def test_stretches_cover_every_token_once_and_end_with_their_document(spark):
    keys = np.sort(np.array([3, 9], np.uint64))
    rows = [(1, "a " * 250, 1), (2, "b " * 96, 0), (3, "", 0), (4, "c", 1)]
    found = toxicity.stretches(labelled(spark, rows), keys, np.ones(2, bool)).collect()
    assert sorted(len(r["slots"]) // 4 for r in found) == [1, 58, 96, 96, 96]
    assert len({r["draw"] for r in found}) == 5
