"""Boolean rules: a parser, and their forms as Spark columns, SQL text and disjunctive normal form.

    rule := term ("|" term)*      term := factor ("&" factor)*      factor := "!"* (name | "0" | "1" | "(" rule ")")

"true" and "false" are constants too. Names are runs of letters, digits and "_".
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CONSTANTS = {"0": False, "1": True, "false": False, "true": True}


class RuleError(ValueError):
    """A rule that cannot be read: what is wrong, and at which character."""

    def __init__(self, problem: str, at: int):
        super().__init__(f"{problem} at character {at}")
        self.problem, self.at = problem, at


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Constant:
    value: bool


@dataclass(frozen=True)
class Not:
    part: Rule


@dataclass(frozen=True)
class All:
    parts: tuple[Rule, ...]


@dataclass(frozen=True)
class Any:
    parts: tuple[Rule, ...]


Rule = Name | Constant | Not | All | Any


def parse(text: str) -> Rule:
    tokens = [(m[0], m.start()) for m in re.finditer(r"[A-Za-z0-9_]+|\S", text)]
    end = len(text)
    at = 0

    def peek() -> str | None:
        return tokens[at][0] if at < len(tokens) else None

    def chain(sign: str, inner: Callable[[], Rule], kind) -> Rule:
        nonlocal at
        parts = [inner()]
        while peek() == sign:
            at += 1
            parts.append(inner())
        return parts[0] if len(parts) == 1 else kind(tuple(parts))

    def rule() -> Rule:
        return chain("|", lambda: chain("&", factor, All), Any)

    def factor() -> Rule:
        nonlocal at
        negated = False
        while peek() == "!":
            at, negated = at + 1, not negated
        token = peek()
        place = tokens[at][1] if at < len(tokens) else end
        if token == "(":
            at += 1
            inner = rule()
            if peek() != ")":
                raise RuleError("a parenthesis is not closed", place)
            at += 1
        elif token and re.fullmatch(r"[A-Za-z0-9_]+", token):
            at += 1
            inner = Constant(CONSTANTS[token.lower()]) if token.lower() in CONSTANTS else Name(token)
        else:
            raise RuleError("a name is expected", place)
        return Not(inner) if negated else inner

    whole = rule()
    if at < len(tokens):
        raise RuleError("something follows the rule", tokens[at][1])
    return whole


def names(rule: Rule) -> Iterator[str]:
    if isinstance(rule, Name):
        yield rule.name
    elif isinstance(rule, Not):
        yield from names(rule.part)
    elif isinstance(rule, All | Any):
        for p in rule.parts:
            yield from names(p)


def text_of(rule: Rule) -> str:
    """The rule as text that parse() reads back to the same value."""
    if isinstance(rule, Name):
        return rule.name
    if isinstance(rule, Constant):
        return "1" if rule.value else "0"
    if isinstance(rule, Not):
        return f"!{text_of(rule.part)}" if isinstance(rule.part, Name | Constant | Not) else f"!({text_of(rule.part)})"
    sign = " & " if isinstance(rule, All) else " | "
    return sign.join(f"({text_of(p)})" if isinstance(p, All | Any) else text_of(p) for p in rule.parts)


def column(rule: Rule, of: Callable[[str], Column]) -> Column:
    """The rule over the columns of(name); Catalyst folds and short-circuits it."""
    if isinstance(rule, Name):
        return of(rule.name)
    if isinstance(rule, Constant):
        return F.lit(rule.value)
    if isinstance(rule, Not):
        return ~column(rule.part, of)
    parts = [column(p, of) for p in rule.parts]
    return reduce(lambda a, b: a & b, parts) if isinstance(rule, All) else reduce(lambda a, b: a | b, parts)


def sql(rule: Rule, of: Callable[[str], str]) -> str:
    """The rule as SQL text that DuckDB and Spark both read."""
    if isinstance(rule, Name):
        return of(rule.name)
    if isinstance(rule, Constant):
        return "TRUE" if rule.value else "FALSE"
    if isinstance(rule, Not):
        return f"(NOT {sql(rule.part, of)})"
    return "(" + (" AND " if isinstance(rule, All) else " OR ").join(sql(p, of) for p in rule.parts) + ")"


def evaluate(rule: Rule, values: dict[str, bool]) -> bool:
    if isinstance(rule, Name):
        return values[rule.name]
    if isinstance(rule, Constant):
        return rule.value
    if isinstance(rule, Not):
        return not evaluate(rule.part, values)
    return (all if isinstance(rule, All) else any)(evaluate(p, values) for p in rule.parts)


Clause = frozenset[tuple[str, bool]]


def clauses(rule: Rule, negated: bool = False, limit: int | None = None) -> set[Clause]:
    """The rule, or its negation, as a set of clauses: sets of (name, positive). A clause that holds a name both ways
    never holds and is left out; so is one that another clause is part of. limit: an error beyond so many products."""
    if isinstance(rule, Name):
        return {frozenset({(rule.name, not negated)})}
    if isinstance(rule, Constant):
        return {frozenset()} if rule.value != negated else set()
    if isinstance(rule, Not):
        return clauses(rule.part, not negated, limit)
    parts = [clauses(p, negated, limit) for p in rule.parts]
    if isinstance(rule, Any) != negated:
        return _least(set().union(*parts))
    found: set[Clause] = {frozenset()}
    for more in parts:
        if limit is not None and len(found) * len(more) > limit:
            raise RuleError(f"more than {limit} products", 0)
        joined = (a | b for a, b in itertools.product(found, more))
        found = _least({c for c in joined if not any((n, not s) in c for n, s in c)})
    return found


def _least(found: set[Clause]) -> set[Clause]:
    """Without clauses that hold another one."""
    kept: list[Clause] = []
    for c in sorted(found, key=len):
        if not any(k <= c for k in kept):
            kept.append(c)
    return set(kept)


def clause_text(clause: Clause, order: list[str] | tuple[str, ...]) -> str:
    """A clause as text, names in the given order; the clause that always holds is "1"."""
    signs = dict(clause)
    return " & ".join(n if signs[n] else f"!{n}" for n in order if n in signs) or "1"


def clause_column(found: set[Clause], of: Callable[[str], Column]) -> Column:
    """A disjunctive normal form over columns."""
    ands = [reduce(lambda a, b: a & b, [of(n) if s else ~of(n) for n, s in sorted(c)], F.lit(True)) for c in sorted(found, key=sorted)]
    return reduce(lambda a, b: a | b, ands, F.lit(False))
