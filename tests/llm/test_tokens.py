import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.orc as orc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing, token_files
from tessera.llm.store import new_path
from tessera.llm.tokens import WordEncoder, default_tokenizer, encode_texts


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(default_tokenizer())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [1]


ODD = ["a b<|endoftext|> c", " x y \x1cq it's", "Σας ΣΑΣ é ́b", "", None, "I'LL don't'd x'  're", "<|startoftext|>", "a b   c\x85d", "ﬁ Å Ångström ẛ̣", "x" * 5000, "a \x01 b", "\x01", "q\x01r \x01\x01", "\u0301a \u0301 Ὀδυσσεύς ΟΔΥΣΣΕΥΣ"]


def test_word_by_word_equals_whole_texts(documents, messy_rows, whole):
    texts = [r["text"] for r in documents.collect()] + [r[1] for r in messy_rows] + ODD
    got = []
    for lo, hi, ids, sizes in encode_texts(pa.array(texts, pa.string()), default_tokenizer()):
        got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [whole(t) for t in texts]


def test_memo_that_overflows(documents, whole, monkeypatch):
    import tessera.llm.tokens as tokens
    from tessera.llm.words import each_slice

    monkeypatch.setattr(tokens, "MEMO_BYTES", 6000)
    monkeypatch.setattr(tokens, "PART", 250)
    monkeypatch.setattr(tokens, "BATCH", 40)
    known = WordEncoder(default_tokenizer())
    texts = [r["text"] for r in documents.limit(60).collect()]
    got = []
    for lo, hi, words in each_slice(pa.array(texts), size=4000):
        ids, sizes = known.ids(words)
        got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [whole(t) for t in texts]


def check_files(spark, df, whole):
    path = new_path(spark, "test-tokens")
    token_files.write_token_files(df.select("doc_id", "text"), path, row_stride=1000)
    spread = F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text", spread).orderBy("doc_id", "h").collect()]
    want, start = [], 0
    for d, t in rows:
        ids = whole(t)
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_files.token_digest(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    return path


def test_round_trip(spark, documents, messy, empty, whole):
    path = check_files(spark, documents, whole)
    files = [f.replace("file://", "") for f in token_files.read_token_files(spark, path).inputFiles()]
    assert files
    ids = []
    for f in sorted(files):
        table = orc.ORCFile(f)
        assert table.nstripes >= 1
        ids += table.read().column("doc_id").to_pylist()
    assert ids == sorted(ids)
    plan = token_files.read_token_files(spark, path).filter("doc_id = 7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,7)" in plan
    check_files(spark, messy, whole)
    check_files(spark, empty, whole)


def test_long_texts_take_several_rows_and_one_id_several_tasks(spark, whole):
    rows = [(7, " ".join(f"w{i % 50} {i}" for i in range(n))) for n in (9000, 0, 1, 3000, 2047, 4095)] + [(7, f"word {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = check_files(spark, df, whole)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = token_files.read_token_files(spark, path)
    assert files.agg(F.max(F.size("ids"))).first()[0] == token_files.ROW_IDS
    assert files.select("file_range").distinct().count() > 1


def check_packing(df, whole, capacity):
    rows = packing.pack_documents(df.select("doc_id", "text"), capacity).collect()
    pieces = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want = Counter()
    for d, t in df.select("doc_id", "text").collect():
        ids = whole(t)
        for i in range(0, len(ids), capacity):
            part = np.array(ids[i : i + capacity], "<u4")
            want[d, i // capacity, i, len(part), zlib.crc32(part.tobytes())] += 1
    assert pieces == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), sum(r["length"] for r in rows)


def test_packing(documents, messy, empty, whole):
    for df, capacity in ((documents, 4096), (documents, 300), (messy, 4096), (messy, 64)):
        used, tokens = check_packing(df, whole, capacity)
        sizes = [len(whole(r["text"])) for r in df.select("text").collect()]
        lengths, counts = np.unique([min(n - at, capacity) for n in sizes for at in range(0, n, capacity)], return_counts=True)
        assert -(-tokens // capacity) <= used <= sum(n for _, n in packing.best_fit(lengths, counts, capacity))
    assert check_packing(empty, whole, 4096) == (0, 0)


def dense(config, n):
    out = np.zeros(n, np.int64)
    out[list(config)] = list(config.values())
    return out


@pytest.mark.parametrize("seed", range(6))
def test_configurations_hold_everything_and_are_few(seed):
    draw = np.random.default_rng(seed)
    lengths = np.sort(draw.choice(np.arange(1, 1001), 60, replace=False))
    counts = draw.integers(1, [5, 5000, 50][seed % 3], 60)
    found = [(dense(c, 60), n) for c, n in packing.solve_configurations(lengths, counts, 1000)]
    assert (sum(c * n for c, n in found) == counts).all() and all(c @ lengths <= 1000 for c, _ in found)
    assert sum(n for _, n in found) <= sum(n for _, n in packing.best_fit(lengths, counts, 1000))


def test_configurations_beat_best_fit_where_it_is_weak():
    lengths, counts = np.array([256, 261, 371, 483, 508]), np.array([6000, 6000, 6000, 6000, 6000]) // 1
    program = sum(n for _, n in packing.solve_configurations(lengths, counts, 1000))
    assert program <= sum(n for _, n in packing.best_fit(lengths, counts, 1000))


def test_knapsack_is_optimal():
    draw = np.random.default_rng(0)
    for _ in range(20):
        lengths, worth = draw.choice(np.arange(2, 30), 5, replace=False), draw.random(5)
        best = np.zeros(61)
        for room in range(1, 61):
            best[room] = max([best[room - 1]] + [best[room - n] + w for n, w in zip(lengths, worth) if n <= room])
        got = packing.knapsack(lengths, worth, np.full(5, 100), 60)
        assert got @ lengths <= 60 and got @ worth >= best[60] - 1e-9
        few = draw.integers(0, 3, 5)
        got = packing.best_configuration(lengths, worth, few, 60)
        assert got @ lengths <= 60 and (got <= few).all()


def test_the_program_places_most_of_the_tokens():
    draw = np.random.default_rng(2)
    lengths, counts = np.unique(np.minimum(draw.lognormal(6.2, 1.1, 12_000).astype(int) + 1, 4096), return_counts=True)
    configurations, program = packing.solve_configurations(lengths, counts, 4096), []
    for config, times in configurations:
        if dense(config, len(lengths)) @ lengths == 4096:
            program.append(times)
    assert sum(program) * 4096 >= 0.8 * (counts @ lengths)
    assert sum(n for _, n in configurations) <= -(-(counts @ lengths) // 4096) + 1
