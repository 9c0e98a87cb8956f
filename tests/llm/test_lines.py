import duckdb

from tessera.llm import lines

ENDS = " \t\x0b\x0c\r"


def brute(rows, least):
    sites, first = {}, {}
    order = sorted({(r["doc_id"], r["text"], r["source"]) for r in rows if r["text"] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    for doc, text, site in order:
        for i, line in enumerate(text.split("\n")):
            key = line.strip(ENDS)
            if not key:
                continue
            first.setdefault(key, (doc, i))
            first[key] = min(first[key], (doc, i), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
            sites.setdefault(key, set())
            if site is not None:
                sites[key].add(site)
    out = []
    for r in rows:
        if r["text"] is None:
            out.append((r["doc_id"], None))
            continue
        keep = [x for i, x in enumerate(r["text"].split("\n")) if not (x.strip(ENDS) and len(sites[x.strip(ENDS)]) >= least and first[x.strip(ENDS)] != (r["doc_id"], i))]
        out.append((r["doc_id"], "\n".join(keep)))
    return sorted(out, key=str)


def test_against_sets(documents, messy, spark):
    shared = [(i, f"own {i}\n shared line \nmid {i % 3}\nfinal", None, f"s{i % 12}", 0) for i in range(60)]
    shared = spark.createDataFrame(shared, "doc_id long, text string, lang string, source string, n_chars long")
    for df in (documents, messy, shared):
        for least in (2, 3, 10, 12):
            got = sorted(((r["id"], r["text"]) for r in lines.drop_boilerplate(df, least).selectExpr("row.doc_id AS id", "text").collect()), key=str)
            assert got == brute(df.collect(), least)


def test_near_the_threshold_counts_are_exact(spark):
    # 95..105 sites: well inside the sketch's error around a threshold of 100
    rows = [(1000 * n + i, f"line of {n}", f"s{i}") for n in range(95, 106) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert lines.boilerplate(df, 100).count() == 6


def test_sql_says_the_same(spark, sf):
    got = lines.op3_line_dedup(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(lines.ORACLE_SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert got.astype(str).values.tolist() == want[got.columns].astype(str).values.tolist()


def test_stage_and_empty(spark, messy, empty, sf):
    out = lines.line_stage(spark, messy, sf)
    assert out.columns == messy.columns and out.count() == messy.count()
    assert lines.line_stage(spark, empty, sf).count() == 0
