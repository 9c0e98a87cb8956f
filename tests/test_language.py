import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.lang import QueryError, forms, parse
from tessera.lang import tree as t
from tessera.lang.parser import parse_where


def test_precedence():
    got = parse_where('NOT a = 1 AND b = 2 OR (c = 3 OR d = 4) AND e IS NULL')
    assert got == t.Or((
        t.And((t.Not(t.Leaf("a", "=", 1)), t.Leaf("b", "=", 2))),
        t.And((t.Or((t.Leaf("c", "=", 3), t.Leaf("d", "=", 4))), t.Leaf("e", "isnull"))),
    ))


def test_literals():
    got = parse('PUT {a: "x\\"y", b: -5, c: 1.5e3, d: true, e: null, f: [1, [2]], g: {h: @"2026-01-02"}, i: $p} IN "l"')
    assert got.records[0] == {"a": 'x"y', "b": -5, "c": 1500.0, "d": True, "e": None, "f": [1, [2]], "g": {"h": t.Stamp("2026-01-02")}, "i": t.Param("p")}


@pytest.mark.parametrize(
    "text, part",
    [
        ('SCAN "l" ORDER BY x', "LIMIT"),
        ('SCAN "l" ORDER BY x LIMIT 3 CURSOR "abc"', "CURSOR"),
        ('FIND "l" WHERE a = 1 OR b = 2', "AND only"),
        ('FIND "l" WHERE NOT a = 1', "AND only"),
        ('DELETE "l"', "PURGE"),
        ('FETCH "a", "b"', "WHERE"),
        ('FETCH "a", "b" WHERE x = 1 AS {one}', "one section name"),
        ('SCAN "l" | AGGREGATE count(), count()', "AS"),
        ('SCAN "l" | AGGREGATE count() WHERE a = 1', "AS"),
        ('SCAN "l" | AGGREGATE median(x)', "unknown aggregate"),
        ('SCAN "l" nonsense', "expected"),
        ('SCAN "l" | SHAPE {a} trailing', "expected"),
        ('CREATE GHOST "v" FROM "l"', "order"),
        ('GRAVITY BY upper(x) IN "l"', "lower and trim"),
        ("", "no statement"),
        ('SCAN "l" WHERE a ~ 1', "unexpected character"),
    ],
)
def test_errors_say_what_is_wrong(text, part):
    with pytest.raises(QueryError, match=part):
        parse(text)


def test_alias_forms_are_one_tree():
    assert parse('SCAN "l" | TOP 3') == parse('SCAN "l" | TAKE 3')
    assert parse('SCAN "l" WHERE a IN (1, 2)') == parse('SCAN "l" WHERE a IN [1, 2]')
    assert parse('SCAN "l" | NEAREST(v, [1.0], 2, cosine)') == parse('SCAN "l" | NEAREST 2 BY v TO [1.0]')
    piped = parse('CREATE GHOST "v" FROM "l" WHERE a = 1 | GROUP BY k | AGGREGATE count(), sum(x) | TAKE BY sum(x) DESC')
    assert piped == parse('CREATE GHOST "v" FROM "l" WHERE a = 1 ORDER BY sum(x) DESC GROUP BY k AGGREGATE count(), sum(x)')


def test_nesting_is_bounded():
    with pytest.raises(QueryError, match="nest"):
        parse('PUT {a: ' + "[" * 30 + "]" * 30 + '} IN "l"')


def test_parameters_are_bound_as_values():
    tree = forms.bind(parse('SCAN "l" WHERE a = $x AND b IN $y'), {"x": '" OR 1', "y": [1, 2]})
    assert tree.steps[0].where == t.And((t.Leaf("a", "=", '" OR 1'), t.Leaf("b", "in", (1, 2))))
    with pytest.raises(QueryError, match="no value"):
        forms.bind(parse('SCAN "l" WHERE a = $x'), {})
    with pytest.raises(QueryError, match="bytes"):
        forms.bind(parse('SCAN "l" WHERE a = $x'), {"x": b"1"})


def test_canonical_form_forgets_order():
    a, b = parse_where("x = 1 AND (y = 2 OR z = 3) AND w = 4"), parse_where("w = 4 AND (x = 1 AND (z = 3 OR y = 2))")
    assert forms.canonical(a) == forms.canonical(b)
    assert forms.canonical(a) != forms.canonical(parse_where("x = 1 AND y = 2 OR z = 3 AND w = 4"))


def test_statements_are_classified():
    assert forms.is_write(parse('SCAN "l" | SET a = 1')) and not forms.is_write(parse('SCAN "l"'))
    assert forms.is_destructive(parse('PURGE "l"')) and forms.is_destructive(parse('SCAN "l" | DELETE'))
    assert not forms.is_write(parse('ANALYZE "l"'))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_no_text_crashes_the_parser(text):
    try:
        parse(text)
    except QueryError:
        pass
