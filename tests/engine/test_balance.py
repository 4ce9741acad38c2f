"""Large components whose rates balance, beside some that do not."""

import numpy as np
import pytest

from stillwater.operators import balance, elimination, solve


def _balanced(n, weight, draw):
    """Edges both ways between the states of a ring with chords, so that the long-run shares are as weight."""
    pairs = {(i, (i + 1) % n) for i in range(n)} | {tuple(sorted(draw.choice(n, 2, replace=False).tolist())) for _ in range(n)}
    flow = {tuple(sorted(p)): float(draw.random() + 0.1) for p in pairs}
    return [(a, b, float(f / weight[a])) for (a, b), f in flow.items()] + [(b, a, float(f / weight[b])) for (a, b), f in flow.items()]


def _solved(spark, edges):
    s = solve.Structure.of(spark.createDataFrame(edges, "src bigint, dst bigint, rate double"), levels=False)
    return {r["state"]: r["p"] for r in solve.stationary(s).collect()}


def test_balanced_rates_need_no_blocks(spark, monkeypatch):
    """Shares over 80 powers of ten."""
    draw = np.random.default_rng(1)
    weight = 10.0 ** draw.uniform(-40, 40, 40)
    edges = _balanced(40, weight, draw)
    monkeypatch.setattr(solve, "DENSE", 8)
    monkeypatch.setattr(elimination.Elimination, "of", lambda *a: pytest.fail("eliminated"))
    got = _solved(spark, edges)
    assert len(got) == 40 and max(abs(got[i] / w - 1) for i, w in enumerate(weight / weight.sum())) < 1e-12


def test_others_are_eliminated(spark, monkeypatch):
    """Beside one component that balances: one with a rate doubled, one with an edge that has no opposite, one with a rate off by a
    10 to the 9th part, one that balances over too wide a range, and one that does not lie within the steps allowed."""
    draw, n = np.random.default_rng(2), 12
    weight = draw.random(n) + 0.5
    made = [_balanced(n, weight, draw) for _ in range(4)]
    a, b, r = made[1][3]
    made[1][3] = (a, b, 2 * r)
    ring = {(i, j) for i in range(n) for j in range(n) if (i - j) % n in (1, n - 1)}
    made[2].remove(next(e for e in made[2] if e[:2] not in ring))
    a, b, r = made[3][3]
    made[3][3] = (a, b, r * (1 + 1e-9))
    made.append([(i, i + 1, 1e-300 if i == 5 else 1.0) for i in range(n - 1)] + [(i + 1, i, 1.0) for i in range(n - 1)])
    made.append([(i, i + 1, 1.0 + i) for i in range(n - 1)] + [(i + 1, i, 2.0) for i in range(n - 1)])
    monkeypatch.setattr(solve, "DENSE", 8)
    monkeypatch.setattr(balance, "STEPS", 8)
    taken, of = [], elimination.Elimination.of
    monkeypatch.setattr(elimination.Elimination, "of", lambda links, leaks, dense: taken.extend(r["own"] for r in links.select("own").distinct().collect()) or of(links, leaks, dense))
    got = _solved(spark, [(a + 100 * c, b + 100 * c, r) for c, edges in enumerate(made) for a, b, r in edges])
    assert sorted(taken) == [100, 200, 300, 400, 500] and len(got) == n * len(made)
    for c, edges in enumerate(made):
        k = np.zeros((n, n))
        for a, b, r in edges:
            k[a, b] = r
        want = elimination.stationary(k)
        assert max(abs(got[100 * c + i] - w) / w if w > 1e-280 else abs(got[100 * c + i] - w) for i, w in enumerate(want / want.sum())) < 1e-12


def test_few_blocks_in_a_file(spark, monkeypatch):
    """A file of a stored table of blocks has no more of them than a task should hold at once."""
    draw, n = np.random.default_rng(5), 12
    k = draw.random((n, n)) + 0.1
    np.fill_diagonal(k, 0.0)
    links = spark.createDataFrame([(0, a, b, float(k[a, b])) for a in range(n) for b in range(n) if a != b], "own bigint, src bigint, dst bigint, rate double").coalesce(1)
    monkeypatch.setattr(elimination, "FILL", 0)
    monkeypatch.setattr(elimination, "FILE", 2 * 8 * 3 * 3)
    e = elimination.Elimination.of(links, spark.createDataFrame([], "own bigint, state bigint, rate double"), 6)
    assert e.most == 2 and len(e.block_rounds) == 3
    for stored in [e.last, *(t for r in e.block_rounds for t in (r.pivots, r.into, r.away))]:
        per_file = stored.groupBy(stored["_metadata"]["file_path"]).count().toPandas()["count"]
        assert len(per_file) and per_file.max() <= 2
    want = elimination.stationary(k)
    got = {r["state"]: r["p"] for r in e.stationary().collect()}
    assert max(abs(got[i] / w - 1) for i, w in enumerate(want / want.sum())) < 1e-12
