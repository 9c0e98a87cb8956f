import random
from collections import Counter, defaultdict

import duckdb
import numpy as np

from tessera.llm import jaccard
from tests_llm_help import near_brute  # noqa: I001

from pyspark.sql import functions as F


def run(df):
    return jaccard.near_groups(df.select("doc_id", "text")).select("doc_id", "class_id", "n_links")


def same(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in run(df).collect())
    assert got == Counter(near_brute(rows))


def test_against_all_pairs(documents, messy):
    same(documents)
    same(messy)


def test_a_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    draw = random.Random(5)
    base = [f"w{draw.randrange(500)}" for _ in range(120)]
    texts = []
    for i in range(700):
        words = list(base)
        for _ in range(draw.choice([0, 1, 1, 2, 3])):
            words[draw.randrange(120)] = f"n{i}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = list(enumerate(texts))
    want = {d: (c, n) for d, c, n in near_brute(rows)}
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in run(df).collect()}
    assert {d: v[0] for d, v in got.items()} == {d: v[0] for d, v in want.items()}
    assert all(got[d][1] <= want[d][1] for d in want)
    assert sum(v[1] for v in got.values()) >= 0.9995 * sum(v[1] for v in want.values())


def test_the_floor_is_the_longest_prefix_that_meets_the_target():
    rate = lambda d: 1 - (1 - 0.8**d) ** jaccard.TREES
    assert jaccard.floor_depth() == 5 and rate(5) >= jaccard.TARGET_RECALL > rate(6)
    assert jaccard.floor_depth(target=0.95) > jaccard.floor_depth(target=0.9999) > jaccard.floor_depth(0.5, 0.9999)


def planted(n, common, own):
    """Pairs of texts that share ``common`` shingles, each with ``own`` of its own."""
    out = []
    for i in range(n):
        shared = [f"c{i}x{j}" for j in range(common + 4)]
        out += [" ".join([*shared, *(f"{side}{i}x{j}" for j in range(own))]) for side in "ab"]
    return out


def test_recall_of_pairs_at_the_threshold(spark):
    df = spark.createDataFrame(list(enumerate(planted(1500, 80, 10))), "doc_id long, text string")
    rows = run(df).collect()
    assert all(r["n_links"] <= 1 for r in rows)
    assert sum(r["n_links"] for r in rows) >= 0.999 * 3000
    below = spark.createDataFrame(list(enumerate(planted(200, 79, 10))), "doc_id long, text string")
    assert not any(r["n_links"] for r in run(below).collect())


def test_dense_nodes_stop_deep_and_sparse_ones_at_the_floor(spark):
    draw = random.Random(6)
    base = [f"t{i}" for i in range(400)]
    dense = [" ".join([*base, f"own{i}"]) for i in range(300)]
    sparse = planted(40, 80, 10) + [" ".join(f"r{draw.randrange(10**9)}" for _ in range(60)) for _ in range(100)]
    rows = list(enumerate(dense + sparse))
    got = {r["doc_id"]: r for r in jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i]["depth"] for i in range(300)} == {jaccard.LEVELS}
    assert {got[i]["depth"] for i in range(300, len(rows))} == {jaccard.floor_depth()}
    assert [(i, got[i]["class_id"], got[i]["n_links"]) for i, _ in rows] == near_brute(rows)


def test_every_pair_is_new_in_one_trie_at_one_depth():
    found = random.Random(1)
    labels = np.array([[found.choice([0, 0, 0x0100, 0x010000, 0x01 << 40, 0x01 << 63]) for _ in range(jaccard.TREES)] for _ in range(30)], np.uint64)
    total = sum(jaccard.new_pairs(labels, t, d).astype(int) for t in range(jaccard.TREES) for d in range(1, jaccard.LEVELS + 1))
    gap = labels[:, None] ^ labels[None]
    assert (total == (gap < np.uint64(1 << 56)).any(axis=2)).all()


def test_sql_says_the_same(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = {tuple(r) for r in jaccard.op4_jaccard_join(spark, sf).collect()}
    assert got == set(con.execute(jaccard.ORACLE_SQL).fetchall())


def test_one_of_each_group_stays(messy, empty):
    kept = jaccard.keep_one(messy)
    assert kept.columns == messy.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    groups = defaultdict(set)
    rows = [(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()]
    for d, c, _ in near_brute(rows):
        groups[c].add(d)
    assert ids == sorted(groups, key=str)
    assert jaccard.keep_one(empty).count() == 0 and run(empty).count() == 0


def test_block_pairs_meet_once(spark):
    from tessera.llm.groups import block_pairs

    df = spark.range(40).withColumn("m", F.lit(40))
    rows = block_pairs(df, F.ceil(F.col("m") / 7), F.xxhash64("id")).collect()
    pairs = Counter()
    by = defaultdict(list)
    for r in rows:
        by[r["lo"], r["hi"]].append((r["id"], r["side"]))
    for (lo, hi), members in by.items():
        for i, (a, sa) in enumerate(members):
            for b, sb in members[:i]:
                if lo == hi or sa != sb:
                    pairs[min(a, b), max(a, b)] += 1
    assert len(pairs) == 40 * 39 // 2 and set(pairs.values()) == {1}


def test_every_pair_is_new_in_one_node_or_unit():
    draw = np.random.default_rng(3)
    same = draw.integers(0, draw.integers(4, 9, (40, 1)) + 1, (40, jaccard.TREES)).astype(np.uint64) * np.uint64(8)  # low bits that are a vertex's own
    labels = draw.integers(0, 1 << 63, (40, jaccard.TREES)).astype(np.uint64) & ((np.uint64(1) << np.minimum(np.uint64(64) - same, np.uint64(63))) - np.uint64(1))
    for depth in (8, 7, 6, 5):
        want = sum(jaccard.new_pairs(labels, t, depth).astype(int) for t in range(jaccard.TREES))
        got = np.zeros_like(want)
        nodes = [(t, p) for t in range(jaccard.TREES) for p in np.unique(labels[:, t] >> np.uint64(8 * (8 - depth)))]
        unit = draw.integers(-1, 3, len(nodes))
        for u in range(3):
            own = np.zeros(40, np.int32)
            for (t, p), at in zip(nodes, unit, strict=True):
                if at == u:
                    own[labels[:, t] >> np.uint64(8 * (8 - depth)) == p] |= 1 << t
            some = np.flatnonzero(own)
            got[np.ix_(some, some)] += jaccard.new_pairs(labels[some], jaccard.TREES, depth, own[some])
        for (t, p), at in zip(nodes, unit, strict=True):
            if at == -1:
                some = np.flatnonzero(labels[:, t] >> np.uint64(8 * (8 - depth)) == p)
                got[np.ix_(some, some)] += jaccard.new_pairs(labels[some], t, depth)
        assert (got == want).all() and want.max() == 1


def test_a_group_of_near_copies_is_sent_once_not_once_per_trie(spark, monkeypatch):
    draw = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(400):
        words = list(base)
        for k in draw.sample(range(120), draw.choice([1, 1, 2])):
            words[k] = f"n{i}x{k}"
        texts.append(" ".join(words))
    sent, verified = [], jaccard._verified

    def counted(rows, depth, threshold):
        sent.append(rows.count())
        return verified(rows, depth, threshold)

    monkeypatch.setattr(jaccard, "_verified", counted)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in run(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {d: (c, n) for d, c, n in near_brute(rows)}
    assert {d: v[0] for d, v in got.items()} == {d: v[0] for d, v in want.items()}
    assert sum(v[1] for v in got.values()) >= 0.9995 * sum(v[1] for v in want.values())
    assert max(sent) < 8 * len(rows)  # node by node there are 15 times as many
