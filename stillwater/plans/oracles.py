"""SQL pieces for the catalogue's oracles: the same relations in plain SQL, and results by other ways (reachability and
power iteration in recursive queries)."""

from __future__ import annotations

from stillwater.functions import boolean
from stillwater.plans import workloads as w
from stillwater.sources.models import BooleanModel

ROW_STATES = "(SELECT CAST(" + " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(w.ROW_BITS)) + " AS BIGINT) AS state FROM lineitem)"
_CODE = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(w.EVENT_TYPES)) + " END"
EVENTS = f"""(SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, CAST(count(*) AS DOUBLE) AS rate FROM (
  SELECT {_CODE} AS src, lead({_CODE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL GROUP BY src, dst)"""
MASKS = f"""(SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, CAST(count(*) AS DOUBLE) AS rate FROM (
  SELECT m AS dst, lag(m) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src FROM (
    SELECT user_id, ts, event_id, bit_or(1 << ({_CODE})) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS m FROM events))
  WHERE src <> dst GROUP BY src, dst)"""
NATIONS = """(SELECT src, dst, CAST(n AS DOUBLE) AS rate FROM (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM (
    SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, count(*) AS n
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    GROUP BY c_nationkey, s_nationkey)) WHERE r <= 2 AND src <> dst)"""
SHARES = "(SELECT CAST(c_nationkey AS BIGINT) AS state, count(*) / sum(count(*)) OVER () AS p FROM customer GROUP BY c_nationkey)"


def rule_sql(model: BooleanModel, i: int, state: str = "state") -> str:
    return boolean.sql(model.rules[i], lambda name: f"(({state} >> {model.place[name]}) & 1 = 1)")


def space(n: int) -> str:
    return f"(SELECT CAST(range AS BIGINT) AS state FROM range({1 << n}))"


def model_edges(model: BooleanModel, states: str | None = None, rates=None) -> str:
    """src, dst, var, up, rate: a query for each node and direction, one after another."""
    states = states or space(len(model.nodes))
    parts = []
    for i in range(len(model.nodes)):
        up, down = rates[i] if rates else (1.0, 1.0)
        on = f"((state >> {i}) & 1 = 1)"
        if up:
            parts.append(f"SELECT state AS src, CAST(state + {1 << i} AS BIGINT) AS dst, CAST({i} AS INTEGER) AS var, TRUE AS up, CAST({up} AS DOUBLE) AS rate FROM {states} WHERE NOT {on} AND {rule_sql(model, i)}")
        if down:
            parts.append(f"SELECT state AS src, CAST(state - {1 << i} AS BIGINT) AS dst, CAST({i} AS INTEGER) AS var, FALSE AS up, CAST({down} AS DOUBLE) AS rate FROM {states} WHERE {on} AND NOT {rule_sql(model, i)}")
    return "(" + " UNION ALL ".join(parts) + ")"


def graph_items() -> str:
    """WITH items after e (edges) and v (vertices): reach (a, b), scc (state, scc), cond (src, dst), term (scc), lev (scc, level)."""
    return """reach(a, b) AS (SELECT state, state FROM v UNION SELECT a, dst FROM reach JOIN e ON b = src),
scc AS MATERIALIZED (SELECT x.a AS state, min(x.b) AS scc FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
cond AS MATERIALIZED (SELECT DISTINCT s.scc AS src, t.scc AS dst FROM e JOIN scc s ON e.src = s.state JOIN scc t ON e.dst = t.state WHERE s.scc <> t.scc),
term AS (SELECT DISTINCT scc FROM scc WHERE scc NOT IN (SELECT src FROM cond)),
longest(scc, n) AS (SELECT DISTINCT scc, 1 FROM scc UNION SELECT cond.src, n + 1 FROM longest JOIN cond ON longest.scc = cond.dst),
lev AS (SELECT scc, CAST(max(n) AS BIGINT) AS level FROM longest GROUP BY scc)"""


def with_graph(edges: str, vertices: str | None = None) -> str:
    """WITH clause: e (edges), v (vertices), and graph_items()."""
    v = f"SELECT state FROM {vertices} UNION " if vertices else ""
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {edges}),
v AS MATERIALIZED ({v}SELECT src AS state FROM e UNION SELECT dst FROM e),
{graph_items()}"""


def peeled(edges: str, rounds: int, only_with: bool = False) -> str:
    """state, round: trimming written out round by round; s<k> are the states left after round k. For graphs of fewer rounds."""
    items = ["e AS MATERIALIZED (SELECT * FROM " + edges + ")", "v AS MATERIALIZED (SELECT src AS state FROM e UNION SELECT dst FROM e)", "s0 AS MATERIALIZED (SELECT state FROM v)"]
    for k in range(1, rounds + 1):
        live = f"(SELECT src, dst FROM e WHERE src IN (SELECT state FROM s{k - 1}) AND dst IN (SELECT state FROM s{k - 1}))"
        items.append(f"s{k} AS MATERIALIZED (SELECT state FROM s{k - 1} WHERE state IN (SELECT src FROM {live} a) AND state IN (SELECT dst FROM {live} b))")
    out = "WITH RECURSIVE " + ",\n".join(items)
    gone = " UNION ALL ".join(f'SELECT state, CAST({k} AS BIGINT) AS "round" FROM s{k - 1} WHERE state NOT IN (SELECT state FROM s{k})' for k in range(1, rounds + 1))
    return out if only_with else f"{out} {gone}"


def iterated(start: str, steps: int) -> str:
    """Further WITH items after with_graph(): y (i, g, state, p), by steps of the uniformised chain from start (g, state, p)."""
    return f""", out AS (SELECT v.state, coalesce(sum(rate), 0) AS total FROM v LEFT JOIN e ON src = v.state WHERE dst IS NULL OR src <> dst GROUP BY v.state),
clock AS (SELECT max(total) * 1.05 AS c FROM out),
moves AS MATERIALIZED (SELECT src, dst, rate / c AS q FROM e, clock WHERE src <> dst UNION ALL SELECT state, state, 1 - total / c FROM out, clock),
y(i, g, state, p) AS (SELECT 0, g, state, CAST(p AS DOUBLE) FROM {start} UNION ALL
  SELECT i + 1, g, dst, sum(p * q) FROM y JOIN moves ON state = src WHERE i < {steps} GROUP BY i, g, dst)"""
