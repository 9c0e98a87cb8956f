import math

import numpy as np

from tessera.llm import caps


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in caps.near_vectors(df).collect()}


def brute(ids, x):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    root = np.arange(len(ids))
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], len(ids)).min(axis=1, initial=len(ids)))
        if (new == root).all():
            break
        root = new
    return {i: (int(linked[k].sum()), ids[root[k]]) for k, i in enumerate(ids)}


def test_recall_of_pairs_just_above_the_threshold(spark):
    draw = np.random.default_rng(2)
    a = draw.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = draw.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = 0.9505
    b = cosine * a + math.sqrt(1 - cosine**2) * side
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b * 3.5]))]
    got = run(spark, rows)
    found = sum(got[i][0] >= 1 for i in range(1500))
    assert found >= 0.995 * 1500
    assert all(n <= 1 for n, *_ in got.values())


def test_large_groups_and_nothing_below(spark):
    draw = np.random.default_rng(3)
    centre = draw.normal(size=64)
    group = centre + 0.2 * draw.normal(size=(900, 64))
    x = np.concatenate([group, draw.normal(size=(300, 64))])
    ids = list(range(10, 10 + len(x)))
    got, want = run(spark, list(zip(ids, x.tolist()))), brute(ids, x)
    assert all(got[i][0] <= want[i][0] for i in ids)
    assert sum(v[0] for v in got.values()) >= 0.999 * sum(v[0] for v in want.values())
    assert {i: v[1] for i, v in got.items()} == {i: v[1] for i, v in want.items()}
    assert all(v[2] == (v[1] == i) for i, v in got.items())


def test_unusable_vectors_and_ties(spark):
    one = [1.0, 0.0, 0.0]
    rows = [
        (1, one), (2, one), (3, [2.0, 0.0, 0.0]), (4, [1e-200, 0.0, 0.0]), (5, [1e200, 1e180, 0.0]), (6, [0.0, 0.0, 0.0]), (7, None), (8, []), (9, [float("nan"), 1.0, 0.0]),
        (10, [float("inf"), 0.0, 0.0]), (11, [None, 1.0, 0.0]), (12, [1.0, 0.0]), (13, [-1.0, 0.0, 0.0]), (None, one),
    ]
    got = run(spark, rows)
    assert all(got[i] == (5, 1, i == 1) for i in (1, 2, 3, 4, 5))
    assert got[None] == (5, 1, False)
    assert all(got[i] == (0, i, True) for i in (6, 7, 8, 9, 10, 11, 12, 13))
    assert run(spark, []) == {}


def test_decoding_lists_every_filter_above_the_height():
    plan = caps.CapPlan(1.2, 3, 7)
    draw = np.random.default_rng(1)
    unit = draw.normal(size=(40, 24))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    row, code = caps.decode(unit, plan)
    rotation, books = caps.code_books(24, 3, 7)
    turned = unit @ rotation
    want = set()
    for r in range(40):
        scores = {}
        for c in range(343):
            parts = (c // 49, c // 7 % 7, c % 7)
            scores[c] = sum(turned[r, 8 * i : 8 * i + 8] @ books[i][p] for i, p in enumerate(parts))
        want |= {(r, c) for c, s in scores.items() if s >= 1.2 / math.sqrt(24)}
        want.add((r, max(scores, key=scores.get)))
    assert set(zip(row.tolist(), code.tolist())) == want


def test_recall_at_other_sizes():
    draw = np.random.default_rng(8)
    for n in (100, 50_000, 5_000_000):
        plan = caps.cap_plan(n, 64)
        a = draw.normal(size=(400, 64))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        side = draw.normal(size=a.shape)
        side -= (side * a).sum(axis=1, keepdims=True) * a
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        one, two = (set(zip(*map(np.ndarray.tolist, caps.decode(x, plan)))) for x in (a, 0.95 * a + math.sqrt(1 - 0.95**2) * side))
        assert len({r for r, _ in one & two}) >= 0.985 * 400
        assert len(one) / 400 < 250


def test_query(spark, sf):
    assert caps.op6_vector_caps(spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()


def test_columns_of_the_operator_s_own_names_are_not_read(spark):
    from pyspark.sql import functions as F

    rows = [(i, [1.0, 0.1 * i]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    more = df.select("*", *[F.lit("own").alias(n) for n in ("k1", "k2", "n", "caps", "cap", "dim", "rep", "component", "n_links", "kept", "side", "lo")])
    assert sorted(map(tuple, caps.near_vectors(more).collect())) == sorted(map(tuple, caps.near_vectors(df).collect()))


def test_sql_says_the_same(spark, sf, tmp_path):
    import duckdb

    draw = np.random.default_rng(5)
    x = np.concatenate([draw.normal(size=16) + 0.2 * draw.normal(size=(30, 16)) for _ in range(8)])
    spark.createDataFrame(list(enumerate(x.astype(np.float32).tolist())), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for folder, files in ((sf, f"{sf}/embeddings.parquet"), (str(tmp_path), f"{tmp_path}/embeddings.parquet/*.parquet")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{files}'")
        df = caps.op6_vector_caps(spark, folder)
        assert {tuple(r) for r in df.collect()} == set(con.execute(caps.ORACLE_SQL).df()[df.columns].itertuples(index=False, name=None))
