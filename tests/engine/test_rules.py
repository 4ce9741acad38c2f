import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stillwater.functions import boolean as b
from stillwater.operators import rates
from stillwater.sources.models import parse_model

NAMES = ["a", "b", "c", "d"]
RULES = st.recursive(
    st.sampled_from(NAMES).map(b.Name) | st.booleans().map(b.Constant),
    lambda inner: st.one_of(inner.map(b.Not), st.lists(inner, min_size=2, max_size=3).map(lambda x: b.All(tuple(x))), st.lists(inner, min_size=2, max_size=3).map(lambda x: b.Any(tuple(x)))),
    max_leaves=8,
)
STATES = [dict(zip(NAMES, v, strict=True)) for v in itertools.product([False, True], repeat=4)]


def holds(clauses, values):
    return any(all(values[n] == s for n, s in c) for c in clauses)


@settings(max_examples=150, deadline=None)
@given(RULES)
def test_forms_agree(rule):
    again = b.parse(b.text_of(rule))
    yes, no = b.clauses(rule), b.clauses(rule, negated=True)
    for v in STATES:
        value = b.evaluate(rule, v)
        assert b.evaluate(again, v) == value
        assert holds(yes, v) == value
        assert holds(no, v) == (not value)


def test_precedence_and_spaces():
    assert b.parse("a|b&!c") == b.Any((b.Name("a"), b.All((b.Name("b"), b.Not(b.Name("c"))))))
    assert b.parse("\t!!( a )") == b.Name("a")


@pytest.mark.parametrize(("text", "at"), [("a b", 2), ("(a", 0), ("a &", 3), ("", 0), ("!|a", 1)])
def test_errors_name_the_place(text, at):
    with pytest.raises(b.RuleError) as e:
        b.parse(text)
    assert e.value.at == at


def test_limit():
    wide = b.Any(tuple(b.All((b.Name(f"x{i}"), b.Name(f"y{i}"))) for i in range(12)))
    with pytest.raises(b.RuleError):
        b.clauses(wide, negated=True, limit=1000)


def test_models():
    m = parse_model("targets, factors\nA,\tA\n\nB, !(A & B) | 0")
    assert m.nodes == ("A", "B") and m.inputs == [0]
    assert m.clause_masks("B") == [(0, 1), (0, 2)]
    assert parse_model("A,A\nB,!( A&B )|0").key == m.key
    for bad in ("A, B", "A, A\nA, A", "A"):
        with pytest.raises(ValueError):
            parse_model(bad)


def test_rates():
    m = parse_model("A, A\nB, A")
    assert rates.uniform(m, up={"A": 2.0}, down=[("B", 1.0), ("B", 3.0)]) == ((2.0, 1.0), (1.0, 3.0))
    assert rates.parse_overrides("U_A=2, d_B=0.5") == ([("A", 2.0)], [("B", 0.5)])
    drawn = rates.normal(m, 1, 2)
    assert drawn == rates.normal(m, 1, 2) and all(x >= 0 for r in drawn for x in r)
    with pytest.raises(ValueError):
        rates.normal(m, -100, 0.1)
    for bad in ({"C": 1.0}, {"A": -1.0}, {"A": float("nan")}):
        with pytest.raises(ValueError):
            rates.uniform(m, up=bad)
