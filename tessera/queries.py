"""Driver queries of the engine's operators and the SQL they must equal.

Each query registers the tables it needs, whole, and runs through the language or the fluent form.
Writes go to a store of their own in the shared folder.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.lang import QueryError
from tessera.lang import tree as t
from tessera.operators import nearest as vectors
from tessera.session import Session
from tessera.sources.sinks import flat_json, tree_json
from tessera.streaming import drain, event_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def put(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return put


def tables(spark: SparkSession, sf_dir: str) -> Session:
    """A session over the given tables, with their keys; nothing is read before a query runs."""
    s = Session(spark)
    at = lambda name: f"{sf_dir}/{name}.parquet"
    s.register("orders", at("orders"), unique="o_orderkey", cluster="o_custkey")
    s.register("customer", at("customer"), unique="c_custkey")
    s.register("lineitem", at("lineitem"), id_field="l_orderkey", cluster="l_orderkey")
    s.register("nation", at("nation"), unique="n_nationkey")
    s.register("events", at("events"), unique="event_id", cluster="user_id", json_fields={"props": "k INT"})
    s.register("documents", at("documents"), unique="doc_id")
    s.register("labels", at("labels"), id_field="doc_id")
    s.register("pages", at("pages"), unique="page_id")
    s.register("conversations", at("conversations"), id_field="turn", cluster="conv_id")
    s.register("embeddings", at("embeddings"), unique="vec_id", cluster="label", vector="embedding")
    return s


def entity(spark: SparkSession, sf_dir: str) -> Session:
    """Customers and orders in one dataset of two record types: fields of the one are missing in the other."""
    s = tables(spark, sf_dir)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("_type", F.lit("Customer")).withColumn("custkey", F.col("c_custkey"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("_type", F.lit("Order")).withColumn("custkey", F.col("o_custkey"))
    both = customers.unionByName(orders, allowMissingColumns=True)
    return s.register("entity", both.withColumn("eid", F.concat("_type", F.lit(":"), F.coalesce("c_custkey", "o_orderkey").cast("string"))), unique="eid", cluster="custkey")


def _local_root(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp()


def store(spark: SparkSession) -> Session:
    """A session with an empty store in the shared folder; a temporary one where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or _local_root(spark)
    session = Session(spark, f"{root.rstrip('/')}/tessera/store-{uuid.uuid4().hex[:12]}")
    _stores.append(session)
    return session


_stores: list[Session] = []


@atexit.register
def _sweep() -> None:
    for session in _stores:
        try:
            session.catalog.file.remove(session.root)
        except Exception:  # Spark may have stopped before
            continue


def _plan(df: DataFrame) -> str:
    """The physical plan, for queries that must read a part of a dataset only."""
    return df._jdf.queryExecution().executedPlan().toString()


def _entity_store(spark: SparkSession, sf_dir: str) -> Session:
    """The same records in a managed dataset, clustered by customer."""
    s = store(spark)
    s.run('LOBE "entity"; GRAVITY BY custkey IN "entity"')
    s.append("entity", entity(spark, sf_dir).dataset("entity"))
    return s


_ENTITY = """(SELECT *, 'Customer' AS _type, c_custkey AS custkey, NULL AS o_orderkey, NULL AS o_custkey, NULL AS o_orderstatus, NULL AS o_totalprice,
   NULL AS o_orderdate, NULL AS o_orderpriority FROM customer
 UNION ALL BY NAME SELECT *, 'Order' AS _type, o_custkey AS custkey FROM orders)"""


# --- scans and predicates ---


@_query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).scan("orders").df().select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@_query("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey LIMIT 2000")
def scan_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables(spark, sf_dir)
    first = s.run('SCAN "orders" WHERE o_totalprice > 1000')
    assert first.has_more and first.cursor and s.run('SCAN "orders" WHERE o_totalprice > 1000 | SHAPE {o_orderkey}').has_more
    assert not s.run('SCAN "nation" | SHAPE {n_name}').has_more
    second = s.run(f'SCAN "orders" WHERE o_totalprice > 1000 LIMIT 1000 CURSOR "{first.cursor}"')
    return first.df.select("o_orderkey").unionAll(second.df.select("o_orderkey"))


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def scan_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flat_json(tables(spark, sf_dir).scan("orders").where('o_orderstatus = "O"').df())
    return rows.select(F.from_json("json", "o_orderkey long, o_totalprice double").alias("r")).select("r.*")


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority = '3-MEDIUM') AND o_totalprice > 100000")
def scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = tables(spark, sf_dir).scan("orders").where('(o_orderstatus = "F" OR o_orderpriority = "3-MEDIUM") AND o_totalprice > 100000')
    return q.shape("o_orderkey", "o_totalprice").df()


@_query("SELECT o_orderkey FROM orders WHERE o_custkey > 10 ORDER BY o_orderkey LIMIT 40 OFFSET 40")
def scan_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables(spark, sf_dir)
    first = s.run('SCAN "orders" WHERE o_custkey > 10 LIMIT 40')
    return s.run(f'SCAN "orders" WHERE o_custkey > 10 LIMIT 40 CURSOR "{first.cursor}"').df.select("o_orderkey")


@_query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7")
def scan_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark)
    s.run('LOBE "o"; GRAVITY BY o_custkey IN "o"')
    s.append("o", spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return s.scan("o").where("o_custkey = 7").df().select("o_orderkey", "o_orderstatus")


@_query("SELECT event_id, value FROM events WHERE user_id = 5 AND event_type = 'click'")
def scan_by_subkey(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark)
    s.run('LOBE "e"; GRAVITY BY user_id IN "e"; SATELLITE BY event_type IN "e"')
    s.append("e", spark.read.parquet(f"{sf_dir}/events.parquet"))
    return s.scan("e").where('user_id = 5 AND event_type = "click"').df().select("event_id", "value")


@_query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_totalprice <= 50000 AND o_orderstatus <> 'F'")
def pred_cmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = tables(spark, sf_dir).scan("orders").where('o_orderdate >= @"1997-01-01" AND o_totalprice <= 50000 AND o_orderstatus != "F"')
    return q.shape("o_orderkey").df()


@_query(f"SELECT _type, count(*) AS n FROM {_ENTITY} WHERE NOT coalesce(o_orderstatus = 'F', false) GROUP BY _type")
def pred_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity(spark, sf_dir).scan("entity").where('NOT o_orderstatus = "F"').group_by("_type").aggregate("count() AS n").df()


@_query(f"SELECT _type, count(*) AS n FROM {_ENTITY} WHERE o_totalprice IS NULL OR c_acctbal IS NOT NULL GROUP BY _type")
def pred_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity(spark, sf_dir).scan("entity").where("o_totalprice IS NULL OR c_acctbal IS NOT NULL").group_by("_type").aggregate("count() AS n").df()


@_query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_custkey IN (1, 2, 3, 5, 8, 13)")
def pred_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).scan("orders").where('o_orderpriority IN ["1-URGENT", "5-LOW"] AND o_custkey IN (1, 2, 3, 5, 8, 13)').shape("o_orderkey").df()


@_query("SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events WHERE CAST(props->>'$.k' AS INTEGER) > 50")
def pred_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).scan("events").where("props.k > 50").df().select("event_id", F.col("props.k").alias("k"))


@_query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), (SELECT string_split(p_name, ' ')[1] FROM part WHERE p_partkey = 1))")
def pred_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("words", F.split("p_name", " "))
    word = part.filter("p_partkey = 1").select(F.col("words")[0]).first()[0]
    s = Session(spark).register("part", part, unique="p_partkey")
    return s.scan("part").where(t.Leaf("words", "contains", word)).shape("p_partkey").df()


@_query("SELECT page_id, url FROM pages")
def shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).scan("pages").shape("page_id", "url", "nowhere").df()


# --- lookups ---


@_query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42")
def find_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).run('FIND "orders" WHERE o_orderkey = 42 | SHAPE {o_orderkey, o_custkey, o_totalprice}').df


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000")
def find_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _orders_store(spark, sf_dir).run('FIND "o" WHERE o_custkey = $key AND o_totalprice > 1000 | SHAPE {o_orderkey, o_totalprice}', {"key": 7}).df
    assert "PartitionFilters: [isnotnull(_bucket" in _plan(df)
    return df.drop("_lid")


@_query("SELECT n_name AS name FROM nation WHERE n_nationkey = 3")
def find_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark)
    s.append("nation", spark.read.parquet(f"{sf_dir}/nation.parquet"))
    lid = s.scan("nation").where("n_nationkey = 3").df().first()["_lid"]
    return s.run(f'FIND LID("{lid}")').df.select(F.col("n_name").alias("name"))


@_query("SELECT o_orderkey FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey LIMIT 3 OFFSET 3")
def find_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables(spark, sf_dir)
    first = s.run('FIND "orders" WHERE o_custkey = 7 LIMIT 3')
    if not first.has_more:
        return first.df.limit(0).select("o_orderkey")
    return s.run(f'FIND "orders" WHERE o_custkey = 7 LIMIT 3 CURSOR "{first.cursor}"').df.select("o_orderkey")


# --- order and limits ---


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).run('SCAN "orders" ORDER BY o_totalprice DESC LIMIT 20 | SHAPE {o_orderkey, o_totalprice}').df


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 ORDER BY o_totalprice, o_orderkey LIMIT 5")
def top_k_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _orders_store(spark, sf_dir).run('SCAN "o" WHERE o_custkey = 7 ORDER BY o_totalprice LIMIT 5 | SHAPE {o_orderkey, o_totalprice}').df
    assert "PartitionFilters: [isnotnull(_bucket" in _plan(df)
    return df.drop("_lid")


@_query("SELECT count(*) AS n FROM (SELECT 1 FROM lineitem LIMIT 17)")
def limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).run('SCAN "lineitem" LIMIT 17').df.agg(F.count(F.lit(1)).alias("n"))


# --- aggregates ---


@_query("""SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total, round(avg(l_discount), 6) AS discount,
           min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'""")
def agg_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = 'SCAN "lineitem" WHERE l_shipdate < @"1998-01-01" | AGGREGATE count() AS n, sum(l_extendedprice) AS total, avg(l_discount) AS discount, min(l_quantity) AS least, max(l_quantity) AS most'
    return tables(spark, sf_dir).run(text).df.withColumns({"total": F.round("total", 2), "discount": F.round("discount", 6)})


@_query("SELECT count(*) AS \"count\" FROM lineitem WHERE l_quantity > 25")
def agg_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).run('SCAN "lineitem" WHERE l_quantity > 25 | AGGREGATE count(*)').df


@_query("SELECT round(sum(l_quantity), 2) AS s, CAST(0 AS DOUBLE) AS none FROM lineitem")
def agg_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables(spark, sf_dir).run('SCAN "lineitem" | AGGREGATE sum(l_quantity) AS s, sum(l_returnflag) AS none').df
    return df.withColumn("s", F.round("s", 2))


@_query("SELECT round(avg(l_tax), 6) AS a, CAST(0 AS DOUBLE) AS none FROM lineitem")
def agg_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables(spark, sf_dir).run('SCAN "lineitem" | AGGREGATE avg(l_tax) AS a, avg(l_comment) AS none').df
    return df.withColumn("a", F.round("a", 6))


@_query("SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem")
def agg_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).run('SCAN "lineitem" | AGGREGATE min(l_extendedprice) AS lo, max(l_extendedprice) AS hi').df


@_query("""SELECT l_returnflag, count(*) AS total, count(*) FILTER (WHERE l_linestatus = 'O') AS open, count(*) FILTER (WHERE l_linestatus = 'F') AS done,
  round(coalesce(sum(l_extendedprice) FILTER (WHERE l_linestatus = 'O'), 0), 2) AS open_sum, round(coalesce(sum(l_extendedprice) FILTER (WHERE l_discount > 0.05), 0), 2) AS cheap_sum,
  round(coalesce(avg(l_tax) FILTER (WHERE l_quantity > 40), 0), 6) AS big_tax, max(l_quantity) FILTER (WHERE l_linestatus = 'F' AND l_tax < 0.02) AS top
  FROM lineitem GROUP BY l_returnflag""")
def agg_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """SCAN "lineitem" | GROUP BY l_returnflag | AGGREGATE count() AS total, count() AS open WHERE l_linestatus = "O", count() AS done WHERE l_linestatus = "F",
      sum(l_extendedprice) AS open_sum WHERE l_linestatus = "O", sum(l_extendedprice) AS cheap_sum WHERE l_discount > 0.05,
      avg(l_tax) AS big_tax WHERE l_quantity > 40, max(l_quantity) AS top WHERE l_linestatus = "F" AND l_tax < 0.02"""
    return tables(spark, sf_dir).run(text).df.withColumns({"open_sum": F.round("open_sum", 2), "cheap_sum": F.round("cheap_sum", 2), "big_tax": F.round("big_tax", 6)})


@_query("SELECT o_custkey, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey, o_orderstatus")
def group_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables(spark, sf_dir).run('SCAN "orders" | GROUP BY o_custkey, o_orderstatus | AGGREGATE count() AS n, sum(o_totalprice) AS s').df
    return df.withColumn("s", F.round("s", 2))


@_query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 200000 GROUP BY o_orderpriority")
def group_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).run('SCAN "orders" WHERE o_orderstatus = "F" OR o_totalprice > 200000 | GROUP BY o_orderpriority | AGGREGATE count() AS n').df


@_query("SELECT o_orderstatus, count(*) AS n FROM " + _ENTITY + " GROUP BY o_orderstatus")
def group_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity(spark, sf_dir).run('SCAN "entity" | GROUP BY o_orderstatus | AGGREGATE count() AS n').df


@_query("""SELECT o_custkey, round(sum(o_totalprice), 2) AS exposure, count(*) AS "count" FROM orders WHERE o_orderstatus IN ('F', 'O')
           GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 100""")
def take_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = 'SCAN "orders" WHERE o_orderstatus IN ["F", "O"] | GROUP BY o_custkey | AGGREGATE sum(o_totalprice) AS exposure, count() | TAKE 100 BY exposure DESC'
    return tables(spark, sf_dir).run(text).df.withColumn("exposure", F.round("exposure", 2))


@_query("SELECT count(*) AS n FROM (SELECT 1 FROM orders WHERE o_totalprice > 0 LIMIT 9)")
def take_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).run('SCAN "orders" WHERE o_totalprice > 0 | TAKE 9').df.agg(F.count(F.lit(1)).alias("n"))


# --- expansion ---


@_query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000)")
def follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The fluent form: records of a SCAN in the language end at its default limit.
    buyers = tables(spark, sf_dir).scan("orders").where('o_orderstatus = "F" AND o_totalprice > 150000').follow("o_custkey", "customer", "c_custkey")
    return buyers.shape("c_custkey", "c_name").df()


@_query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def follow_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).scan("labels").where("toxic = 1").follow("doc_id", "documents", "doc_id").shape("doc_id", "lang").df()


@_query(f"SELECT _type, CAST(custkey AS BIGINT) AS custkey, count(*) AS n FROM {_ENTITY} WHERE custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000) GROUP BY _type, custkey")
def pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _entity_store(spark, sf_dir)
    df = s.scan("entity").where("o_totalprice > 250000").pull().df()
    assert "dynamicpruning" in _plan(df)  # buckets without a wanted key are not read
    return df.groupBy("_type", "custkey").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def pull_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entity_store(spark, sf_dir).scan("entity").where("o_totalprice > 250000").pull(1, "Customer").shape("c_custkey", "c_name").df().drop("_lid")


@_query("SELECT c_custkey FROM customer")
def pull_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity(spark, sf_dir).run('PULL FROM "entity" only=Customer').df.select("c_custkey")


@_query("SELECT n_nationkey FROM nation WHERE n_regionkey = 1 OR n_nationkey IN (0, 3) OR n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3)")
def pull_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark)
    s.run('LOBE "n"; GRAVITY BY n_nationkey IN "n"')
    s.append("n", spark.read.parquet(f"{sf_dir}/nation.parquet"))
    near = spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_nationkey = 3").first()["n_regionkey"]
    s.run('LINK "n" WHERE n_regionkey = 1 AND n_nationkey != 3 TO "n" WHERE n_nationkey = 0 AS "near"; LINK "n" WHERE n_nationkey = 0 TO "n" WHERE n_nationkey = 3 AS "next"')
    s.run('LINK "n" WHERE n_regionkey = $r AND n_nationkey != 3 AND n_nationkey != 0 TO "n" WHERE n_nationkey = 3 AS "of"', {"r": near})
    return s.run('FIND "n" WHERE n_nationkey = 0 | PULL depth=3').df.select("n_nationkey")


@_query("SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def follow_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _customers(spark, sf_dir)
    s.append("o", spark.read.parquet(f"{sf_dir}/orders.parquet"))
    s.run('LINK "c" WHERE c_custkey = 7 TO "o" WHERE o_custkey = 7 AS "placed"')
    return s.run('FIND "c" WHERE c_custkey = 7 | FOLLOW _link_placed TO "o" ON _lid | SHAPE {o_orderkey}').df.drop("_lid")


@_query("""SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders
   WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables(spark, sf_dir)
    s.register("buyers", s.scan("orders").where('o_orderstatus = "F"').follow("o_custkey", "customer", "c_custkey").df(), unique="c_custkey")
    df = s.run('SCAN "buyers" WHERE c_acctbal > 5000 | FOLLOW c_custkey TO "orders" ON o_custkey | AGGREGATE count() AS n, sum(o_totalprice) AS s').df
    return df.withColumn("s", F.round("s", 2))


@_query("SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def pull_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).scan("conversations").where('role = "system"').pull().shape("conv_id", "turn").df()


@_query("""SELECT CAST(1 AS BIGINT) AS parents, count(*) AS children, CAST(1 + count(*) AS BIGINT) AS pulled FROM nation WHERE n_regionkey = 1""")
def pull_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark)
    s.run('LOBE "geo"; GRAVITY BY root IN "geo"')
    s.run('PUT {root: "r1", _type: "Region", key: 1} IN "geo"')
    nations = [r["n_name"] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_regionkey = 1").collect()]
    rows = tuple({"_type": "Nation", "name": n} for n in nations)
    s.run(t.Put("geo", rows, ((),) * len(rows), True, t.LinkTo("geo", t.Leaf("key", "=", 1), "in_region")))
    df = s.run('FIND "geo" WHERE key = 1 | PULL').df
    one = lambda kind: F.count(F.when(F.col("_type") == kind, 1))
    return df.agg(one("Region").alias("parents"), one("Nation").alias("children"), F.count(F.lit(1)).alias("pulled"))


@_query("SELECT n_name AS name, 1 AS depth FROM nation WHERE n_regionkey = 3 UNION ALL SELECT 'region', 0")
def pull_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark)
    s.run('LOBE "geo"; GRAVITY BY root IN "geo"; PUT {root: "r3", name: "region"} IN "geo"')
    rows = tuple({"name": r["n_name"]} for r in spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_regionkey = 3").collect())
    s.run(t.Put("geo", rows, ((),) * len(rows), True, t.LinkTo("geo", t.Leaf("name", "=", "region"), "in_region")))
    roots = tree_json(s.run('FIND "geo" WHERE name = "region" | PULL').df)
    flat = [(r["name"], 0) for r in roots] + [(c["name"], 1) for r in roots for c in r.get("children", [])]
    return spark.createDataFrame(flat, "name string, depth int")


@_query(f"""WITH RECURSIVE e AS (SELECT * FROM orders WHERE o_custkey = 7)
  SELECT (SELECT count(*) FROM customer WHERE c_custkey = 7) AS customers, count(*) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM e""")
def fetch_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables(spark, sf_dir)
    s.register("who", spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("key", F.col("c_custkey")), unique="key")
    s.register("what", spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("key", F.col("o_custkey")), unique="o_orderkey", cluster="key")
    df = s.run('FETCH "who", "what" WHERE key = 7 AS {customers, orders}').df
    total = F.aggregate("orders", F.lit(0.0), lambda a, o: a + F.coalesce(o["o_totalprice"], F.lit(0.0)))
    return df.select(F.size("customers").cast("long").alias("customers"), F.size("orders").cast("long").alias("orders"), F.round(total, 2).alias("total"))


# --- vector search ---


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    row = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]]


def _near(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    s = tables(spark, sf_dir)
    df = s.run(text, {"q": _probe(spark, sf_dir)}).df
    return df.select("vec_id", "label")


_PROBE = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"


@_query(f"SELECT vec_id, label FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_PROBE}) DESC, vec_id LIMIT 25")
def nearest_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 'SCAN "embeddings" | NEAREST 25 BY embedding TO $q USING cosine')


@_query(f"SELECT vec_id, label FROM embeddings ORDER BY list_dot_product(CAST(embedding AS DOUBLE[]), {_PROBE}) DESC, vec_id LIMIT 25")
def nearest_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 'SCAN "embeddings" | NEAREST(embedding, $q, 25, dot)')


@_query(f"SELECT vec_id, label FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), {_PROBE}), vec_id LIMIT 25")
def nearest_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 'SCAN "embeddings" | NEAREST 25 BY embedding TO $q USING l2')


@_query(f"SELECT vec_id, label FROM embeddings WHERE label = 3 AND vec_id > 50 ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_PROBE}) DESC, vec_id LIMIT 10")
def nearest_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 'SCAN "embeddings" WHERE label = 3 AND vec_id > 50 | NEAREST 10 BY embedding TO $q')


@_query(f"SELECT vec_id, label FROM embeddings WHERE vec_id <> 0 ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_PROBE}) DESC, vec_id LIMIT 10")
def nearest_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).run('SCAN "embeddings" | NEAREST(embedding, REF "0", 10, cosine)').df.select("vec_id", "label")


@_query(f"""SELECT vec_id, label FROM embeddings WHERE label NOT IN (1, 2)
   ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_PROBE}) DESC, vec_id LIMIT 25""")
def nearest_nonfinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("label") == 1, float("nan")).when(F.col("label") == 2, float("inf"))
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("embedding", F.transform("embedding", lambda x, i: F.when(i == 3, F.coalesce(odd, x)).otherwise(x)))
    s = Session(spark).register("embeddings", df, unique="vec_id")
    return s.run('SCAN "embeddings" | NEAREST 25 BY embedding TO $q', {"q": _probe(spark, sf_dir)}).df.select("vec_id", "label")


def _vectors(spark: SparkSession, sf_dir: str) -> Session:
    s = store(spark)
    s.run('LOBE "v"; VECTOR embedding IN "v"; GRAVITY BY label IN "v"')
    s.append("v", spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return s


@_query(f"SELECT vec_id, label FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), {_PROBE}), vec_id LIMIT 40")
def nearest_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).run('SCAN "v" | NEAREST 40 BY embedding TO $q USING l2', {"q": _probe(spark, sf_dir)}).df.select("vec_id", "label")


@_query("SELECT CAST(max(len(embedding)) AS INTEGER) AS dim FROM embeddings")
def vector_declare(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _vectors(spark, sf_dir)
    try:
        s.run('PUT {vec_id: -1, embedding: [1.0, 2.0]} IN "v"')
    except QueryError:  # another dimension
        return spark.createDataFrame([(int(line.split("dim ")[1]),) for line in s.run('SHOW PROFILE "v"').info if "dim " in line], "dim int")
    raise AssertionError("a vector of another dimension was taken")


@_query(f"""SELECT label, vec_id, rank FROM (SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label
   ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_PROBE}) DESC, vec_id) AS INTEGER) AS rank FROM embeddings) WHERE rank <= 3""")
def nearest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables(spark, sf_dir).dataset("embeddings")
    out = vectors.nearest_per_key(df, "label", "embedding", _probe(spark, sf_dir), 3, "vec_id")
    return out.select("label", "vec_id", F.col("_rank").cast("int").alias("rank"))


@_query(f"""SELECT count(*) AS n, round(avg(label), 6) AS mean FROM (SELECT label FROM embeddings
   ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_PROBE}) DESC, vec_id LIMIT 50)""")
def nearest_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables(spark, sf_dir).run('SCAN "embeddings" | NEAREST 50 BY embedding TO $q | AGGREGATE count() AS n, avg(label) AS mean', {"q": _probe(spark, sf_dir)}).df
    return df.withColumn("mean", F.round("mean", 6))


# --- writes ---


def _customers(spark: SparkSession, sf_dir: str, more: str = "") -> Session:
    s = store(spark)
    s.run(f'LOBE "c"; ANCHOR "c_custkey" UNIQUE IN "c"; GRAVITY BY c_nationkey IN "c"{more}')
    s.append("c", spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return s


@_query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def ingest_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark)
    s.append("l", spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return s.scan("l").where("l_quantity > 45").df().select("l_orderkey", "l_linenumber", "l_quantity")


@_query("""SELECT c_custkey, CASE WHEN c_custkey IN (1, 2) THEN 'renamed' ELSE c_name END AS c_name, c_acctbal FROM customer
   UNION ALL SELECT -1, 'new', CAST(NULL AS DOUBLE)""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _customers(spark, sf_dir)
    s.run('PUT BATCH IN "c" [{c_custkey: 1, c_name: "renamed"}, {c_custkey: 2, c_name: "renamed"}, {c_custkey: -1, c_name: "new"}] ON CONFLICT UPDATE')
    return s.scan("c").df().select("c_custkey", "c_name", "c_acctbal")


@_query("""SELECT CASE WHEN c_custkey = 3 THEN -5 ELSE c_custkey END AS c_custkey, c_name,
   CASE WHEN c_custkey = 3 THEN 1.5 WHEN c_custkey = 4 THEN 2.5 ELSE c_acctbal END AS c_acctbal FROM customer""")
def upsert_two_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark)
    s.run('LOBE "c"; ANCHOR "c_custkey" UNIQUE IN "c"; ANCHOR "c_name" UNIQUE IN "c"; GRAVITY BY c_nationkey IN "c"')
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    s.append("c", customers)
    third = customers.filter("c_custkey = 3").first()["c_name"]
    s.run('PUT BATCH IN "c" [{c_custkey: -5, c_name: $n, c_acctbal: 1.5}, {c_custkey: 4, c_acctbal: 2.5}] ON CONFLICT UPDATE', {"n": third})
    try:
        s.run('PUT {c_custkey: 5, c_name: $n} IN "c" ON CONFLICT UPDATE', {"n": third})
    except QueryError:  # it meets customer 5 and would take the other's name
        return s.scan("c").df().select("c_custkey", "c_name", "c_acctbal")
    raise AssertionError("a second record took the same name")


@_query("SELECT count(DISTINCT c_nationkey) AS indexed, count(*) - count(DISTINCT c_nationkey) AS duplicates FROM customer")
def autoanchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = _customers(spark, sf_dir).run('AUTOANCHOR APPLY "c_nationkey" IN "c"').info
    return spark.createDataFrame([(info["indexed"], info["duplicates"])], "indexed long, duplicates long")


@_query("SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = 3")
def pin(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _customers(spark, sf_dir, '; PIN c_acctbal IN "c"; PIN c_name IN "c"; UNPIN c_name IN "c"')
    s.run('CREATE GHOST "p" FROM "c" WHERE c_nationkey = 3 | TAKE BY c_custkey | EMBED c_custkey')
    # The fluent form: records of a SCAN GHOST in the language end at its default limit.
    df = s.scan_view("p").df()
    assert "c_name" not in df.columns
    return df.select("c_custkey", "c_acctbal")


@_query("SELECT count(*) AS cached, count(*) + 1 AS later FROM customer")
def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _customers(spark, sf_dir)
    cached = s.run('INCACHE "c"').info["cached"]
    assert s.run("SHOW CACHE").info == ["c"]
    s.run('PUT {c_custkey: -7, c_nationkey: 1} IN "c"')
    later = s.run('SCAN "c" | AGGREGATE count() AS n').rows()[0]["n"]
    s.run('OUTCACHE "c"')
    return spark.createDataFrame([(cached, later)], "cached long, later long")


@_query("""SELECT 'c' AS name, count(*) AS n_records, true AS managed FROM customer UNION ALL SELECT 'nation', count(*), false FROM nation""")
def show(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _customers(spark, sf_dir)
    s.register("nation", f"{sf_dir}/nation.parquet", unique="n_nationkey")
    assert s.run('SHOW ANCHORS IN "c"').info == ["c_custkey"] and "  Gravity: c_nationkey" in s.run('SHOW PROFILE "c"').info
    return s.run("SHOW LOBES").df


@_query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE lower(c_mktsegment) = (SELECT lower(c_mktsegment) FROM customer WHERE c_custkey = 1) GROUP BY c_mktsegment")
def key_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark)
    s.run('LOBE "c"; ANCHOR "c_custkey" UNIQUE IN "c"; GRAVITY BY lower(c_mktsegment) IN "c"')
    s.append("c", spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return s.run('FIND "c" WHERE c_custkey = 1 | PULL').df.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@_query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' OR c_acctbal < 0 THEN 'X' ELSE c_mktsegment END AS c_mktsegment,
   CASE WHEN c_mktsegment = 'BUILDING' OR c_acctbal < 0 THEN 24 ELSE c_nationkey END AS c_nationkey FROM customer""")
def set_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _customers(spark, sf_dir)
    s.run('SET "c" c_mktsegment = "X", c_nationkey = 24 WHERE c_mktsegment = "BUILDING" OR c_acctbal < 0')
    return s.scan("c").df().select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("int").alias("c_nationkey"))


@_query("SELECT c_custkey FROM customer WHERE NOT (c_nationkey = 3 OR c_acctbal > 9000)")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _customers(spark, sf_dir)
    s.run('DELETE "c" WHERE c_nationkey = 3; SCAN "c" WHERE c_acctbal > 9000 | DELETE')
    return s.scan("c").df().select("c_custkey")


@_query("SELECT CAST(0 AS BIGINT) AS left_over, CAST(1 AS BIGINT) AS added")
def purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _customers(spark, sf_dir)
    s.run('PURGE "c"')
    left = s.scan("c").df().agg(F.count(F.lit(1)).alias("left_over"))
    s.run('PUT {c_custkey: 5, c_nationkey: 1} IN "c"')
    return left.crossJoin(s.scan("c").df().agg(F.count(F.lit(1)).alias("added")))


@_query("""SELECT n.n_name AS name, r.r_name AS region FROM nation n JOIN region r ON r.r_regionkey = 2 WHERE n.n_regionkey = 2""")
def link(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark)
    s.append("nation", spark.read.parquet(f"{sf_dir}/nation.parquet"))
    s.append("region", spark.read.parquet(f"{sf_dir}/region.parquet"))
    s.run('LINK "nation" WHERE n_regionkey = 2 TO "region" WHERE r_regionkey = 2 AS "lies_in"')
    found = s.run('SCAN "nation" WHERE _link_lies_in IS NOT NULL | FOLLOW _link_lies_in TO "region" ON _lid').df
    linked = s.scan("nation").where("_link_lies_in IS NOT NULL").df().withColumnRenamed("_lid", "own")
    return linked.join(found, linked["_link_lies_in"] == found["_lid"]).select(F.col("n_name").alias("name"), F.col("r_name").alias("region"))


# --- views ---


def _orders_store(spark: SparkSession, sf_dir: str) -> Session:
    s = store(spark)
    s.run('LOBE "o"; ANCHOR "o_orderkey" UNIQUE IN "o"; GRAVITY BY o_custkey IN "o"')
    s.append("o", spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return s


_TOTALS = """CREATE GHOST "totals" FROM "o" WHERE o_orderstatus = "F" | GROUP BY o_custkey, o_orderpriority
  | AGGREGATE count(), sum(o_totalprice), avg(o_totalprice), min(o_totalprice), max(o_totalprice) | TAKE BY sum(o_totalprice) DESC"""


@_query("SELECT o_orderkey, o_totalprice, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def scan_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _orders_store(spark, sf_dir)
    s.run('CREATE GHOST "dear" FROM "o" WHERE o_orderstatus = "F" | TAKE BY o_totalprice DESC | EMBED o_orderkey, o_totalprice, o_custkey')
    df = s.scan_view("dear").where("o_totalprice > 200000").df()
    return df.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(15).select("o_orderkey", "o_totalprice", "o_custkey")


@_query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey, o_orderpriority")
def view_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _orders_store(spark, sf_dir)
    s.run(_TOTALS)
    df = s.run('SCAN "o" WHERE o_orderstatus = "F" | GROUP BY o_custkey, o_orderpriority | AGGREGATE count() AS n, sum(o_totalprice) AS s').df
    assert list(s.routed) == ["totals"]
    return df.select("o_custkey", "n", F.round("s", 2).alias("s"))


_AFTER = """(SELECT o_orderkey, o_custkey, CASE WHEN o_custkey = 7 THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
   CASE WHEN o_custkey = 7 THEN 5.5 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders WHERE NOT (o_totalprice > 280000 OR o_orderkey < 100)
   UNION ALL SELECT -1, 1, 'F', 123.25, '1-URGENT')"""


def _changed(spark: SparkSession, sf_dir: str, view: str) -> Session:
    s = _orders_store(spark, sf_dir)
    s.run(view)
    s.run('PUT {o_orderkey: -1, o_custkey: 1, o_orderstatus: "F", o_totalprice: 123.25, o_orderpriority: "1-URGENT"} IN "o"')
    s.run('DELETE "o" WHERE o_totalprice > 280000 OR o_orderkey >= 0 AND o_orderkey < 100')
    s.run('SET "o" o_orderstatus = "F", o_totalprice = 5.5 WHERE o_custkey = 7')
    return s


@_query(f"SELECT o_custkey, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a FROM {_AFTER} WHERE o_orderstatus = 'F' GROUP BY o_custkey, o_orderpriority")
def view_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _changed(spark, sf_dir, 'CREATE GHOST "v" FROM "o" WHERE o_orderstatus = "F" | GROUP BY o_custkey, o_orderpriority | AGGREGATE count(), sum(o_totalprice), avg(o_totalprice) | TAKE BY count()')
    df = s.run('SCAN "o" WHERE o_orderstatus = "F" | GROUP BY o_custkey, o_orderpriority | AGGREGATE count() AS n, sum(o_totalprice) AS s, avg(o_totalprice) AS a').df
    assert list(s.routed) == ["v"]
    return df.withColumns({"s": F.round("s", 2), "a": F.round("a", 4)})


@_query(f"SELECT o_custkey, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM {_AFTER} GROUP BY o_custkey")
def view_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _changed(spark, sf_dir, 'CREATE GHOST "x" FROM "o" | GROUP BY o_custkey | AGGREGATE min(o_totalprice), max(o_totalprice) | TAKE BY o_custkey')
    df = s.run('SCAN "o" | GROUP BY o_custkey | AGGREGATE min(o_totalprice) AS lo, max(o_totalprice) AS hi').df
    assert list(s.routed) == ["x"]
    return df


@_query("SELECT o_custkey, o_orderpriority, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL ORDER BY sum(o_totalprice) DESC, o_custkey, o_orderpriority LIMIT 10")
def view_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _orders_store(spark, sf_dir)
    s.run(_TOTALS)
    df = s.run('SCAN "o" WHERE o_orderstatus = "F" | GROUP BY o_custkey, o_orderpriority | AGGREGATE sum(o_totalprice) AS s | TAKE 10 BY s').df
    assert list(s.routed) == ["totals"]
    return df.withColumn("s", F.round("s", 2))


@_query(f"""SELECT o_orderkey, o_custkey, o_totalprice FROM {_AFTER} WHERE o_orderstatus = 'F' AND o_totalprice < 250000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 60""")
def view_route_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _changed(spark, sf_dir, 'CREATE GHOST "done" FROM "o" WHERE o_orderstatus = "F" | TAKE BY o_totalprice DESC')
    urgent = s.scan("o").where('o_orderstatus = "F" AND o_orderpriority = "1-URGENT"')
    counted, read = urgent.aggregate("count() AS n").df().first()["n"], urgent.df().count()  # by the base, by the view
    df = s.run('SCAN "o" WHERE o_totalprice < 250000 AND o_orderstatus = "F" ORDER BY o_totalprice DESC LIMIT 60 | SHAPE {o_orderkey, o_custkey, o_totalprice}').df
    assert list(s.routed) == ["done", "done"] and counted == read
    return df.drop("_lid")


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 20000")
def view_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _orders_store(spark, sf_dir)
    s.run('CREATE GHOST "by_price" FROM "o" | TAKE BY o_totalprice')
    df = s.run('SCAN GHOST "by_price" WHERE o_totalprice >= 1000 AND o_totalprice < 20000 LIMIT 10000').df
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThanOrEqual(o_totalprice" in _plan(df)
    routed = s.scan("o").where("o_totalprice >= 1000 AND o_totalprice < 20000").df()
    assert list(s.routed) == ["by_price"]
    return routed.select("o_orderkey", "o_totalprice")


@_query("SELECT o_custkey, o_orderpriority, round(sum(o_totalprice), 2) AS s, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL ORDER BY sum(o_totalprice) DESC, o_custkey, o_orderpriority LIMIT 25")
def view_metric_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _orders_store(spark, sf_dir)
    s.run(_TOTALS)
    df = s.run('SCAN "o" WHERE o_orderstatus = "F" | GROUP BY o_custkey, o_orderpriority | AGGREGATE sum(o_totalprice) AS s, count() AS n | TAKE 25 BY s').df
    assert list(s.routed) == ["totals"] and "GreaterThanOrEqual(_metric" in _plan(df)  # groups below the 64th are skipped
    return df.withColumn("s", F.round("s", 2))


@_query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_orderstatus = 'F'")
def view_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _orders_store(spark, sf_dir)
    s.run('CREATE GHOST "f" FROM "o" WHERE o_orderstatus = "F" | AGGREGATE count(), sum(o_totalprice) | TAKE BY count()')
    s.run('DROP GHOST "f"')
    df = s.run('SCAN "o" WHERE o_orderstatus = "F" | AGGREGATE count() AS n, sum(o_totalprice) AS s').df
    assert not s.routed
    return df.withColumn("s", F.round("s", 2))


@_query("""SELECT 'F' AS kind, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'all', count(*) FROM orders""")
def batch_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _orders_store(spark, sf_dir)
    s.run("""CREATE GHOST "f" FROM "o" WHERE o_orderstatus = "F" | AGGREGATE count() | TAKE BY count();
             CREATE GHOST "all" FROM "o" | AGGREGATE count() | TAKE BY count()""")
    one = lambda kind, where: s.run(f'SCAN "o"{where} | AGGREGATE count() AS n').df.select(F.lit(kind).alias("kind"), "n")
    out = one("F", ' WHERE o_orderstatus = "F"').unionAll(one("all", ""))
    assert list(s.routed) == ["f", "all"]
    return out


@_query("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 7 GROUP BY o_custkey, o_orderpriority")
def view_route_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _orders_store(spark, sf_dir)
    s.run(_TOTALS)
    df = s.run('SCAN "o" WHERE o_custkey = 7 AND o_orderstatus = "F" | GROUP BY o_custkey, o_orderpriority | AGGREGATE count() AS n').df
    assert list(s.routed) == ["totals"]
    return df


@_query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 200000 GROUP BY o_orderpriority")
def view_or_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _orders_store(spark, sf_dir)
    s.run('CREATE GHOST "all" FROM "o" | GROUP BY o_orderpriority | AGGREGATE count() | TAKE BY count() DESC')
    df = s.run('SCAN "o" WHERE o_orderstatus = "F" OR o_totalprice > 200000 | GROUP BY o_orderpriority | AGGREGATE count() AS n').df
    assert not s.routed
    return df


@_query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_orderstatus = 'O'")
def scan_via_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _orders_store(spark, sf_dir)
    s.run('CREATE GHOST "open" FROM "o" WHERE o_orderstatus = "O" | AGGREGATE count(), sum(o_totalprice) | TAKE BY count()')
    df = s.run('SCAN "o" WHERE o_orderstatus = "O" | AGGREGATE count() AS n, sum(o_totalprice) AS s').df
    assert list(s.routed) == ["open"]
    return df.withColumn("s", F.round("s", 2))


@_query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def view_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark)
    s.run('LOBE "o"; CREATE GHOST "n" FROM "o" | GROUP BY o_custkey | AGGREGATE count() | TAKE BY count() DESC')
    s.run("BULKMODE ON")
    s.append("o", spark.read.parquet(f"{sf_dir}/orders.parquet"))
    s.run("BULKMODE OFF")
    df = s.run('SCAN "o" | GROUP BY o_custkey | AGGREGATE count() AS n').df
    assert list(s.routed) == ["n"]
    return df


# --- streams, introspection, links as a tree ---


@_query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS s FROM events GROUP BY event_type")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark)
    s.run('LOBE "e"; CREATE GHOST "by_type" FROM "e" | GROUP BY event_type | AGGREGATE count(), sum(value) | TAKE BY count() DESC')
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A table is one file here and a folder of files elsewhere; a glob reads both.
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    plain = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(folder).isFile()
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet" if plain else path)
    drain(s, stream, "e", f"{s.root}/checkpoints/e").awaitTermination()
    df = s.run('SCAN "e" | GROUP BY event_type | AGGREGATE count() AS n, sum(value) AS s').df
    assert list(s.routed) == ["by_type"]
    return df.withColumn("s", F.round("s", 2))


@_query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = event_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "event_type")
    return out.select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@_query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, out = f"{sf_dir}/events.parquet", f"{store(spark).root}/windows"
    schema = spark.read.parquet(path).schema
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    plain = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(folder).isFile()
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet" if plain else path)
    counts = event_counts(stream, "ts", "event_type")
    # Every batch leaves the whole result so far; the last one stays.
    writer = counts.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    writer.option("checkpointLocation", f"{out}-checkpoints").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@_query("SELECT 'o_custkey >' AS pattern, 5 AS hits")
def advise(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables(spark, sf_dir)
    for key in range(5):
        s.run('SCAN "orders" WHERE o_custkey > $k', {"k": key})
    return spark.createDataFrame([(p, n) for _, p, n in s.advise()], "pattern string, hits int")


@_query("SELECT count(*) AS n, CAST(count(*) FILTER (WHERE n_regionkey = 1) AS BIGINT) AS gone FROM nation")
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark)
    s.append("nation", spark.read.parquet(f"{sf_dir}/nation.parquet"))
    s.run('SNAPSHOT CREATE before; DELETE "nation" WHERE n_regionkey = 1')
    before = s.snapshot("before").scan("nation").df().agg(F.count(F.lit(1)).alias("n"))
    after = s.scan("nation").df().agg(F.count(F.lit(1)).alias("m"))
    return before.crossJoin(after).select("n", (F.col("n") - F.col("m")).alias("gone"))


@_query("""SELECT * FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderdate'), ('o_orderpriority')) f(field)
  JOIN LATERAL (SELECT CASE field WHEN 'o_orderkey' THEN count(DISTINCT o_orderkey) WHEN 'o_custkey' THEN count(DISTINCT o_custkey) WHEN 'o_orderstatus' THEN count(DISTINCT o_orderstatus)
  WHEN 'o_totalprice' THEN count(DISTINCT o_totalprice) WHEN 'o_orderdate' THEN count(DISTINCT o_orderdate) ELSE count(DISTINCT o_orderpriority) END AS n_distinct FROM orders) ON true""")
def analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).run('ANALYZE "orders"').df.select("field", "n_distinct")
