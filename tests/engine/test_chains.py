"""Loops over long paths: chains taken together give what going round by round gives, in few jobs."""

from __future__ import annotations

import random

import pytest

from stillwater.operators import graph
from stillwater.operators.chains import chains

EDGES = "src bigint, dst bigint"


def long_graph(seed):
    """A random graph whose edges are paths, with cycles of links alone and parallel chains."""
    rng = random.Random(seed)
    edges, name = set(), 20
    for _ in range(26):
        a, b = rng.randrange(14), rng.randrange(14)
        path = [a, *range(name, name + rng.randint(0, 12)), b]
        name += len(path) - 2
        edges |= set(zip(path[:-1], path[1:], strict=True))
    for n in (3, 30):
        ring = list(range(name, name + n))
        rng.shuffle(ring)
        edges |= set(zip(ring, ring[1:] + ring[:1], strict=True))
        name += n
    shift = {i: j for i, j in enumerate(rng.sample(range(name), name))}
    return {(shift[a], shift[b]) for a, b in edges if a != b}, set(shift.values())


def reachable(edges, start):
    seen, todo = set(start), list(start)
    after = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    while todo:
        for b in after.get(todo.pop(), []):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_reach_through_chains(spark, monkeypatch, seed):
    monkeypatch.setattr(graph, "HASTE", 1)
    edges, states = long_graph(seed)
    df, vertices = spark.createDataFrame(sorted(edges), EDGES), spark.createDataFrame([(s,) for s in sorted(states)], "state bigint")
    to = {s: reachable(edges, [s]) for s in states}
    want = {s: min(t for t in to[s] if s in to[t]) for s in states}
    assert {r["state"]: r["scc"] for r in graph.strong_components(df, vertices).collect()} == want
    start = sorted(states)[:2]
    got = {r["state"] for r in graph.forward(df, vertices.where(vertices.state.isin(start))).collect()}
    assert got == to[start[0]] | to[start[1]]


def test_levels_through_chains(spark, monkeypatch):
    monkeypatch.setattr(graph, "HASTE", 1)
    rng = random.Random(3)
    edges, name = set(), 12
    for _ in range(25):
        a, b = sorted(rng.sample(range(12), 2))
        path = [a, *range(name, name + rng.randint(0, 9)), b]
        name += len(path) - 2
        edges |= set(zip(path[:-1], path[1:], strict=True))
    level = {}

    def of(s):
        if s not in level:
            level[s] = 1 + max((of(b) for a, b in edges if a == s), default=0)
        return level[s]

    want = {s: of(s) for s in range(name)}
    got = graph.levels(spark.createDataFrame(sorted(edges), EDGES), spark.range(name).withColumnRenamed("id", "scc")).collect()
    assert {r["scc"]: r["level"] for r in got} == want


def test_a_long_path_takes_few_jobs(spark):
    """100,000 states in a row, in random order of names."""
    n = 100_000
    path = spark.range(n - 1).selectExpr("(id * 70001) % 100000 AS src", "((id + 1) * 70001) % 100000 AS dst")
    tracker = spark.sparkContext.statusTracker()
    count = lambda group: len(tracker.getJobIdsForGroup(group))
    for group, run in (
        ("levels", lambda: graph.levels(path, spark.range(n).withColumnRenamed("id", "scc")).agg({"level": "max"}).first()[0] == n),
        ("reach", lambda: graph.forward(path, spark.range(1).withColumnRenamed("id", "state")).count() == n),
        ("scc", lambda: graph.strong_components(path, spark.range(n).withColumnRenamed("id", "state")).where("state <> scc").isEmpty()),
    ):
        spark.sparkContext.setJobGroup(group, group)
        assert run()
        assert count(group) < 150, (group, count(group))  # with AQE a stage that is shuffled is a job of its own
    spark.sparkContext.setJobGroup("rest", "rest")


def test_chains_of_one_graph(spark):
    edges = [(0, 1), (1, 2), (2, 3), (3, 0), (3, 4), (4, 5), (7, 8), (8, 7), (0, 9), (9, 10), (10, 3)]
    c = chains(spark.createDataFrame(edges, EDGES))
    assert {(r["state"], r["head"], r["tail"], r["before"], r["after"]) for r in c.members.collect()} == {(1, 0, 3, 1, 2), (2, 0, 3, 2, 1), (9, 0, 3, 1, 2), (10, 0, 3, 2, 1), (4, 3, 5, 1, 1)}
    assert {tuple(r) for r in c.cycles.collect()} == {(7, 7), (8, 7)}
    assert {tuple(r) for r in c.edges.collect()} == {(0, 3, 3), (3, 0, 1), (3, 5, 2)}
