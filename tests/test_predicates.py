"""Random predicates over missing, null and mixed values, against a plain evaluator."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.lang import tree as t
from tessera.session import Session

MISSING = object()
ROWS = [
    {"id": 1, "n": 50, "s": "a", "l": [1, 2], "m": {"k": 1, "r": [{"w": 0.5}]}},
    {"id": 2, "n": None, "s": "b", "l": [], "m": {"k": 2, "r": []}},
    {"id": 3, "s": "a", "l": [3]},
    {"id": 4, "n": 10, "s": None},
    {"id": 5, "n": 50, "l": [2, 2], "m": {"k": 1, "r": [{"w": 2.5}]}},
]


def value(row, path):
    at = row
    for part in path.split("."):
        if isinstance(at, dict) and part in at:
            at = at[part]
        elif isinstance(at, list) and part.isdigit() and int(part) < len(at):
            at = at[int(part)]
        else:
            return MISSING
    return at


def kind(x):
    return "n" if isinstance(x, (int, float)) and not isinstance(x, bool) else type(x).__name__


def holds(node, row):
    if isinstance(node, t.And):
        return all(holds(p, row) for p in node.parts)
    if isinstance(node, t.Or):
        return any(holds(p, row) for p in node.parts)
    if isinstance(node, t.Not):
        return not holds(node.part, row)
    x, v = value(row, node.path), node.value
    if node.op == "isnull":
        return x is MISSING or x is None
    if node.op == "notnull":
        return x is not MISSING and x is not None
    if x is MISSING:
        return False
    if node.op == "contains":
        return isinstance(x, list) and v in x
    if node.op == "in":
        return any(x is None if w is None else kind(x) == kind(w) and x == w for w in v)
    same = x is None and v is None or kind(x) == kind(v) and x == v
    if node.op == "=":
        return same
    if node.op == "!=":
        return not same
    if x is None or v is None or kind(x) != kind(v):
        return False
    return {">": x > v, ">=": x >= v, "<": x < v, "<=": x <= v}[node.op]


numbers, texts = st.sampled_from([10, 50, 50.0, 7, None]), st.sampled_from(["a", "b", "z", None])
leaves = st.one_of(
    st.builds(t.Leaf, st.just("n"), st.sampled_from(["=", "!=", ">", ">=", "<", "<="]), st.one_of(numbers, st.just("a"))),
    st.builds(t.Leaf, st.just("s"), st.sampled_from(["=", "!=", ">", "<="]), st.one_of(texts, st.just(5))),
    st.builds(t.Leaf, st.just("n"), st.just("in"), st.lists(st.one_of(numbers, st.just("a")), min_size=1, max_size=3).map(tuple)),
    st.builds(t.Leaf, st.just("l"), st.just("contains"), st.sampled_from([1, 2, 9, "a"])),
    st.builds(t.Leaf, st.sampled_from(["m.k", "l.0", "m.r.0.w", "nowhere", "m.nowhere"]), st.sampled_from(["=", "!=", ">", "<"]), st.sampled_from([1, 2, 0.5])),
    st.builds(t.Leaf, st.sampled_from(["n", "s", "l", "nowhere"]), st.sampled_from(["isnull", "notnull"])),
)
trees = st.recursive(leaves, lambda x: st.one_of(st.builds(t.Not, x), st.lists(x, min_size=2, max_size=3).map(lambda p: t.And(tuple(p))), st.lists(x, min_size=2, max_size=3).map(lambda p: t.Or(tuple(p)))), max_leaves=5)


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    s = Session(spark, f"file://{tmp_path_factory.mktemp('store')}")
    s.run(t.Put("r", tuple(ROWS), ((),) * len(ROWS), True))
    return s


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(trees, min_size=6, max_size=6))
def test_random_predicates(session, nodes):
    from pyspark.sql import functions as F

    from tessera.plans.predicates import Predicates

    df = session.dataset("r")
    compiled = [Predicates(df.schema).compile(n) for n in nodes]
    # One job for several predicates; as a filter would, a null counts as false.
    got = {r["id"]: r for r in df.select("id", *[F.coalesce(c, F.lit(False)).alias(f"p{i}") for i, c in enumerate(compiled)]).collect()}
    for i, node in enumerate(nodes):
        want = {r["id"] for r in ROWS if holds(node, r)}
        assert {k for k, r in got.items() if r[f"p{i}"]} == want, node


def test_equality_under_not_is_pushed_to_the_scan(spark, sf):
    s = Session(spark).register("o", f"{sf}/orders.parquet", unique="o_orderkey")
    plan = s.scan("o").where('NOT o_orderstatus = "F" AND o_totalprice > 5').df()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice" in plan and "Not(EqualNullSafe(o_orderstatus" in plan


def test_strict_types(spark):
    df = spark.createDataFrame([(1, 5.0)], "id long, x double")
    loose, strict = (Session(spark, strict_types=b).register("r", df, unique="id") for b in (False, True))
    assert loose.scan("r").where("x = 5").df().count() == 1
    assert strict.scan("r").where("x = 5").df().count() == 0
