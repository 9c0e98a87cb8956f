"""One text of 250,000 words beside short ones, through every operator that reads texts."""

import hashlib

import pytest
from tokenizers import Tokenizer

from tessera.llm import jaccard, lines, mixing, ngram, packing, quality, substring, token_files, toxicity
from tessera.llm.store import new_path
from tessera.llm.tokens import default_tokenizer

WORDS = [f"w{i % 7919}x{i // 7919}" for i in range(250_000)]
LONG = "\n".join(" ".join(WORDS[i : i + 50]) for i in range(0, len(WORDS), 50))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "a short text of nine words for the start", "s"), (2, LONG, "s"), (3, LONG + "\nthe end", "t"), (4, "another short text", "t"), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()


def by_id(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()}


def test_quality(docs):
    got = by_id(quality.with_quality(docs).select("doc_id", "quality_figures.*"), "n_words", "word_chars", "n_repeat_words", "n_dup_lines")
    assert got[2] == (250_000, sum(map(len, WORDS)), 0, 0) and got[3][0] == 250_002 and got[5][0] == 0


def test_lines(docs):
    got = by_id(lines.drop_boilerplate(docs, 2).selectExpr("row.doc_id AS doc_id", "n_lines", "n_removed", "text"), "n_lines", "n_removed", "text")
    assert got[2] == (5000, 0, LONG) and got[3] == (5001, 5000, "the end") and got[5] == (0, 0, None)


def test_near_copies(docs):
    assert by_id(jaccard.near_groups(docs.select("doc_id", "text")), "class_id", "n_links") == {1: (1, 0), 2: (2, 1), 3: (2, 1), 4: (4, 0), 5: (5, 0)}


def test_passages(docs):
    got = by_id(substring.drop_repeats(docs.select("doc_id", "text")), "n_words", "n_removed", "kept_sha256")
    assert got[2] == (250_000, 0, hashlib.sha256(" ".join(WORDS).encode()).hexdigest())
    assert got[3] == (250_002, 250_000, hashlib.sha256(b"the end").hexdigest())


def test_tokens(spark, docs):
    whole = Tokenizer.from_file(default_tokenizer())
    size = len(whole.encode(LONG, add_special_tokens=False).ids) + 1
    path = new_path(spark, "test-long")
    token_files.write_token_files(docs.select("doc_id", "text"), path)
    assert by_id(token_files.token_digest(spark, path), "n_tokens")[2] == size
    pieces = packing.pack_documents(docs.select("doc_id", "text")).filter("doc_id = 2").collect()
    assert len(pieces) == -(-size // 4096) and sum(r["length"] for r in pieces) == size
    counted = mixing.counted_rows(docs)
    assert by_id(counted.selectExpr("row.doc_id AS doc_id", "n_tokens"), "n_tokens")[2] == size


def test_scores(docs):
    trie = ngram.train_model(docs, shard_tokens=100_000)
    got = by_id(ngram.score(docs, trie), "n_tokens", "n_known")
    assert got[2] == (250_001, 250_001) and got[5] == (1, 1)
    assert by_id(toxicity.tag(docs, toxicity.Field()), "score") == dict.fromkeys(range(1, 6), 0.5)


def test_figures_at_their_thresholds_pass(spark):
    ten = " ".join(f"und{i}" for i in range(10))
    nine = " ".join(f"und{i}" for i in range(9))
    loop = "a b c d e " * 2  # ten words in repeated windows
    rows = [(1, ten), (2, nine), (3, loop + " ".join(f"und{i}" for i in range(40))), (4, loop + " ".join(f"und{i}" for i in range(39)))]
    got = by_id(quality.with_quality(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "quality_figures.*"), "n_words", "n_repeat_words", "base_failed")
    assert got == {1: (10, 0, False), 2: (9, 0, True), 3: (50, 10, False), 4: (49, 10, True)}
