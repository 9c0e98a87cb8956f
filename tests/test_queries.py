"""Every engine query against its SQL on another engine, and the driver's entry."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from tessera.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in row) for row in df.itertuples(index=False)), list(df.columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, oracle, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert plain(got) == plain(oracle.execute(ORACLE_SQL[name]).df())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["o_custkey", "exposure", "count"] and df.count() == 100


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name, larger", [("follow", "sf0.01"), ("pull_sessions", "sf0.1")])
def test_records_beyond_the_languages_default_limit(spark, sf, name, larger):
    """Over 1,000 customers and turns: a plan that ends in records through the language gives the first 1,000 of them."""
    at = sf.replace("sf0.001", larger)
    con = duckdb.connect()
    for path in glob.glob(f"{at}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    assert plain(QUERIES[name](spark, at).toPandas()) == plain(con.execute(ORACLE_SQL[name]).df())


def repeated_customers(folder, copies):
    """``customer`` of sf0.1 so many times over, with keys and names of their own, and its SQL's connection."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT c_custkey + 15000 * i AS c_custkey, 'Customer#' || lpad(CAST(c_custkey + 15000 * i AS VARCHAR), 9, '0') AS c_name, c_nationkey, c_acctbal, c_mktsegment
       FROM '/root/testdata/sf0.1/customer.parquet', range({copies}) t(i)) TO '{folder}/customer.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{folder}/customer.parquet'")
    return con


def test_views_records_beyond_the_languages_default_limit(spark, tmp_path):
    """A view of 1,284 records, of which SCAN GHOST in the language gives 1,000."""
    con = repeated_customers(tmp_path, 2)
    assert plain(QUERIES["pin"](spark, str(tmp_path)).toPandas()) == plain(con.execute(ORACLE_SQL["pin"]).df())


def test_a_views_first_records_are_of_all_its_records(spark, tmp_path):
    """1,500 orders of one price, the least key last: SCAN GHOST in the language gives the 1,000 that were written first."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT CAST(1500 - i AS BIGINT) AS o_orderkey, CAST(7 AS BIGINT) AS o_custkey, 'F' AS o_orderstatus, CAST(250000.5 AS DOUBLE) AS o_totalprice
       FROM range(1500) t(i)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    assert plain(QUERIES["scan_view"](spark, str(tmp_path)).toPandas()) == plain(con.execute(ORACLE_SQL["scan_view"]).df())
