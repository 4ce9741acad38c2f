"""The named queries over the test tables, and the SQL that recomputes each by another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwater.functions import bits, boolean
from stillwater.operators import graph, matrix, rates, solve, states, transitions
from stillwater.operators.numbering import number
from stillwater.operators.storage import keep
from stillwater.plans import corpus
from stillwater.plans import oracles as o
from stillwater.plans import workloads as w
from stillwater.plans.solver import Solver
from stillwater.sources.models import clause_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
STEPS = 600


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(c: str | Column, to: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, to) + F.lit(0.0)


def _r(expression: str, to: int = 6) -> str:
    return f"round({expression}, {to}) + 0.0"


# --------------------------------------------------------------------------- rules, states, rates

_RULES = ", ".join(f"count(*) FILTER (WHERE {o.rule_sql(w.ROWS, i)}) AS on_{n.lower()}" for i, n in enumerate(w.ROWS.nodes))
_OFF = ", ".join(f"count(*) FILTER (WHERE NOT {o.rule_sql(w.ROWS, i)}) AS off_{n.lower()}" for i, n in enumerate(w.ROWS.nodes))


def _per_state(df: DataFrame, prefix: str, value: Callable[[int, Column], Column]) -> DataFrame:
    aggs = [F.count_if(value(i, F.col("state"))).alias(f"{prefix}_{n.lower()}") for i, n in enumerate(w.ROWS.nodes)]
    return df.groupBy("state").agg(*aggs)


_COUNTED = f"(SELECT state, count(*) AS n FROM {o.ROW_STATES} GROUP BY state)"


def _counted(spark, sf_dir, bits_: int = 5) -> DataFrame:
    """state, n: how many line items are in each state, of the first bits_ nodes."""
    rows = w.row_states(spark, sf_dir)
    return rows.select(F.col("state").bitwiseAND(F.lit((1 << bits_) - 1)).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


def _taken(spark, sf_dir, states_: DataFrame) -> DataFrame:
    """states, and n: how many line items are in each."""
    return states_.join(_counted(spark, sf_dir), "state", "left").na.fill(0, ["n"])


@query(f"SELECT s.state, coalesce(n, 0) AS n FROM {o.space(5)} s LEFT JOIN {_COUNTED} c ON s.state = c.state")
def state_space(spark, sf_dir):
    """All states, and how many line items are in each."""
    return _taken(spark, sf_dir, states.space(spark, 5))


@query(f"SELECT s.state, coalesce(n, 0) AS n FROM {o.space(5)} s LEFT JOIN {_COUNTED} c ON s.state = c.state WHERE s.state & {(1 << 1) | (1 << 4)} = {1 << 4}")
def subcube(spark, sf_dir):
    return _taken(spark, sf_dir, states.subcube(spark, 5, {1: 0, 4: 1}))


@query(f"SELECT state, count(*) AS n FROM {o.ROW_STATES} GROUP BY state")
def row_state_hist(spark, sf_dir):
    return w.row_states(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


@query(f"SELECT state, {_RULES} FROM {o.ROW_STATES} GROUP BY state")
def rule_eval(spark, sf_dir):
    """Rules as columns over a state for each lineitem row."""
    return _per_state(w.row_states(spark, sf_dir), "on", lambda i, s: transitions.rule_value(w.ROWS, i, s))


@query(f"SELECT state, {_RULES} FROM {o.ROW_STATES} GROUP BY state")
def dnf_clauses_eval(spark, sf_dir):
    """The same by clause masks."""
    masks = [w.ROWS.clause_masks(n) for n in w.ROWS.nodes]
    return _per_state(w.row_states(spark, sf_dir), "on", lambda i, s: transitions.clause_value(masks[i], s))


@query(f"SELECT state, {_OFF} FROM {o.ROW_STATES} GROUP BY state")
def rule_negation(spark, sf_dir):
    """Negated rules by the clause masks of their negations."""
    masks = [w.ROWS.clause_masks(n, negated=True) for n in w.ROWS.nodes]
    return _per_state(w.row_states(spark, sf_dir), "off", lambda i, s: transitions.clause_value(masks[i], s))


@query(" UNION ALL ".join(f"SELECT '{n}' AS node, state, n FROM {_COUNTED} WHERE {o.rule_sql(w.ROWS, i)}" for i, n in enumerate(w.ROWS.nodes)))
def clause_table_eval(spark, sf_dir):
    """Clauses as a relation: the states of line items in which any clause of a node holds."""
    clauses = clause_table(spark, w.ROWS)
    nodes = spark.createDataFrame(list(enumerate(w.ROWS.nodes)), "node_idx int, node string")
    held = _counted(spark, sf_dir).join(F.broadcast(clauses), bits.matches(F.col("state"), F.col("p_mask"), F.col("n_mask")))
    return held.select("node_idx", "state", "n").distinct().join(F.broadcast(nodes), "node_idx").select("node", "state", "n")


@query(f"SELECT s.state, CAST(0.03125 AS DOUBLE) AS p, coalesce(n, 0) AS n FROM {o.space(5)} s LEFT JOIN {_COUNTED} c ON s.state = c.state")
def initial_uniform(spark, sf_dir):
    """Every state alike, beside the line items in it."""
    return _taken(spark, sf_dir, states.uniform(spark, w.ROWS))


def _usual(spark, sf_dir) -> tuple[dict[str, int], list[int], int]:
    """For each node the value that more than half of the line items have (else 0), how many have it on, and how many there are."""
    on = [F.count_if(bits.bit(F.col("state"), i)).alias(n) for i, n in enumerate(w.ROWS.nodes)]
    row = w.row_states(spark, sf_dir).agg(F.count("*").alias("all_"), *on).first()
    return {n: int(2 * row[n] > row["all_"]) for n in w.ROWS.nodes}, [row[n] for n in w.ROWS.nodes], row["all_"]


_ON = ", ".join(f"count(*) FILTER ((state >> {i}) & 1 = 1) AS on_{i}" for i in range(5))
_USUAL = "(SELECT *, " + " + ".join(f"CASE WHEN 2 * on_{i} > total THEN {1 << i} ELSE 0 END" for i in range(5)) + f" AS usual FROM (SELECT count(*) AS total, {_ON} FROM {o.ROW_STATES}))"


@query(f"SELECT state, CAST(0.125 AS DOUBLE) AS p FROM {o.space(5)}, {_USUAL} WHERE state & 5 = usual & 5")
def initial_fixed(spark, sf_dir):
    """Two nodes fixed at what most line items have."""
    usual, _, _ = _usual(spark, sf_dir)
    return states.fixed(spark, w.ROWS, {n: usual[n] for n in ("R", "D")})


@query(f"SELECT state, {_r('CASE WHEN state & 8 = 8 THEN on_3 / total / 16 ELSE (total - on_3) / total / 16 END', 9)} AS p FROM {o.space(5)}, {_USUAL}")
def initial_fixed_prob(spark, sf_dir):
    """One node on with the probability that it is in a line item."""
    _, on, total = _usual(spark, sf_dir)
    return states.fixed(spark, w.ROWS, {"T": 1}, on[3] / total).select("state", rounded("p", 9).alias("p"))


@query(f"SELECT state, {_r('count(*) / sum(count(*)) OVER ()', 9)} AS p FROM {o.ROW_STATES} GROUP BY state")
def initial_empirical(spark, sf_dir):
    return states.empirical(w.row_states(spark, sf_dir)).select("state", rounded("p", 9).alias("p"))


@query(f"SELECT CAST(i AS INTEGER) AS var, node, CAST(CASE i WHEN 1 THEN on_1 WHEN 3 THEN on_3 ELSE 1 END AS DOUBLE) AS up_rate, CAST(CASE i WHEN 0 THEN total - on_0 ELSE 1 END AS DOUBLE) AS down_rate FROM {_USUAL}, (VALUES {', '.join(f"({i}, '{n}')" for i, n in enumerate(w.ROWS.nodes))}) AS v(i, node)")
def rates_override(spark, sf_dir):
    """Rates read from text, which is made of counts of line items."""
    _, on, total = _usual(spark, sf_dir)
    up, down = rates.parse_overrides(f"u_F={on[1]},d_R={total - on[0]},u_T={on[3]}")
    return rates.rate_table(spark, w.ROWS, rates.uniform(w.ROWS, up, down))


@query("""SELECT c_name AS node, CASE WHEN n % 2 = 0 THEN CAST(n AS DOUBLE) END AS given, TRUE AS again_the_same, TRUE AS not_negative, TRUE AS near_the_mean, CAST(n AS BIGINT) AS n
FROM (SELECT n_name AS c_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name)""")
def rates_normal(spark, sf_dir):
    """A node for each nation, with drawn rates; where a nation's suppliers are even in number, they are its rate up."""
    from stillwater.sources.models import BooleanModel

    nations, suppliers = w.table(spark, sf_dir, "nation"), w.table(spark, sf_dir, "supplier")
    counts = nations.join(suppliers, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy(F.col("n_name").alias("node")).agg(F.count("s_suppkey").alias("n"))
    found = {r["node"]: r["n"] for r in counts.collect()}  # a row for each nation
    model = BooleanModel(tuple(sorted(found)), tuple(boolean.Name(n) for n in sorted(found)))
    given = {n: float(c) for n, c in found.items() if c % 2 == 0}
    one, two = (rates.rate_table(spark, model, rates.normal(model, 5.0, 0.5, up=given, seed=1)) for _ in range(2))
    same = two.select("node", F.col("up_rate").alias("up_2"), F.col("down_rate").alias("down_2"))
    near = (F.abs(F.col("down_rate") - 5) < 3) & (F.col("n") % 2 == 0) | (F.abs(F.col("down_rate") - 5) < 3) & (F.abs(F.col("up_rate") - 5) < 3)
    return one.join(same, "node").join(counts, "node").select(
        "node", F.when(F.col("n") % 2 == 0, F.col("up_rate")).alias("given"), ((F.col("up_rate") == F.col("up_2")) & (F.col("down_rate") == F.col("down_2"))).alias("again_the_same"),
        ((F.col("up_rate") >= 0) & (F.col("down_rate") >= 0)).alias("not_negative"), near.alias("near_the_mean"), "n",
    )


@query(f"SELECT state, {_r('CASE WHEN state & 9 = usual & 9 THEN 0.5 / 8 ELSE 0.5 / 24 END', 9)} AS p FROM {o.space(5)}, {_USUAL}")
def initial_parsed(spark, sf_dir):
    """Nodes fixed by text, with half of the probability: the text is what most line items have."""
    usual, _, _ = _usual(spark, sf_dir)
    text = ", ".join(f"{n}={usual[n]}" for n in ("R", "T"))
    return states.fixed(spark, w.ROWS, states.parse_fixed(text), 0.5).select("state", rounded("p", 9).alias("p"))


@query(f"""SELECT node, string_agg(text, ' & ' ORDER BY i) AS clause, any_value(rows_) AS n FROM (
  SELECT node, p, n, i, CASE WHEN (p >> i) & 1 = 1 THEN name ELSE '!' || name END AS text, (SELECT count(*) FROM {o.ROW_STATES} WHERE state & p = p AND state & n = 0) AS rows_
  FROM (VALUES {", ".join(f"('{x}', {p}, {n})" for x in w.ROWS.nodes for p, n in w.ROWS.clause_masks(x))}) AS c(node, p, n),
    (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(w.ROWS.nodes))}) AS names(i, name) WHERE ((p | n) >> i) & 1 = 1) GROUP BY node, p, n""")
def clauses_printed(spark, sf_dir):
    """Clauses as text, and for how many line items each holds."""
    clauses = clause_table(spark, w.ROWS)
    held = _counted(spark, sf_dir).join(F.broadcast(clauses), bits.matches(F.col("state"), F.col("p_mask"), F.col("n_mask")))
    counts = clauses.join(held.groupBy("node_idx", "clause_idx").agg(F.sum("n").alias("n")), ["node_idx", "clause_idx"], "left").na.fill(0, ["n"])
    name = F.get(F.array(*map(F.lit, w.ROWS.nodes)), "node_idx")
    return counts.select(name.alias("node"), bits.clause_text(F.col("p_mask"), F.col("n_mask"), list(w.ROWS.nodes)).alias("clause"), F.col("n").cast("long").alias("n"))


_ORDERED = """(SELECT extract('month' FROM o_orderdate) AS month, """ + ", ".join(f"count(*) FILTER (o_orderpriority LIKE '{i + 1}%' AND o_orderstatus = 'P') AS n_{i}" for i in range(5)) + " FROM orders GROUP BY 1)"


@query(f"""SELECT CAST(a.month AS INTEGER) AS month, CAST(b.month AS INTEGER) AS other, {" AND ".join(f"(a.n_{i} = 0) = (b.n_{i} = 0)" for i in range(5))} AS reusable
FROM {_ORDERED} a, {_ORDERED} b WHERE a.month < b.month""")
def zero_pattern_compatible(spark, sf_dir):
    """Rates up from the open orders of each priority in a month: between which months a stored graph could be used again."""
    orders = w.table(spark, sf_dir, "orders")
    counted = [F.count_if(F.col("o_orderpriority").startswith(str(i + 1)) & (F.col("o_orderstatus") == "P")).alias(n) for i, n in enumerate(w.ROWS.nodes)]
    months = orders.groupBy(F.month("o_orderdate").alias("month")).agg(*counted).collect()  # twelve rows at most
    made = {r["month"]: rates.uniform(w.ROWS, up={n: float(r[n]) for n in w.ROWS.nodes}) for r in months}
    rows = [(a, b, rates.compatible(made[a], made[b])) for a in sorted(made) for b in sorted(made) if a < b]
    return spark.createDataFrame(rows, "month int, other int, reusable boolean")


# --------------------------------------------------------------------------- transitions

_MODELS = (("toy", w.TOY), ("ring", w.RING), ("pair", w.PAIR), ("latch", w.LATCH), ("rows", w.ROWS))


def _some(model) -> str:
    """SQL: the states that line items have of a model's nodes, and how many."""
    return f"(SELECT state & {(1 << len(model.nodes)) - 1} AS state, count(*) AS n FROM {o.ROW_STATES} GROUP BY 1)"


_ALL = " UNION ALL ".join(f"SELECT '{n}' AS model, src, dst, var, up, n FROM {o.model_edges(m, _some(m))} JOIN {_some(m)} c ON src = c.state" for n, m in _MODELS)


def _moves(spark, sf_dir, model, rates_=None) -> DataFrame:
    """src, dst, var, up, rate, n: the model's transitions from the states that line items have of its nodes; n: how many are there."""
    counted = keep(_counted(spark, sf_dir, len(model.nodes)))
    return transitions.successors(counted.select("state"), model, rates_).join(counted.withColumnRenamed("state", "src"), "src")


@query(_ALL)
def transitions_all(spark, sf_dir):
    """Several models' transitions from the states of line items."""
    parts = [_moves(spark, sf_dir, m).select(F.lit(n).alias("model"), "src", "dst", "var", "up", "n") for n, m in _MODELS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"SELECT src, dst, var, up, rate, n FROM {o.model_edges(w.TOY, _some(w.TOY), rates=((1.0, 1.0), (1.0, 0.0), (2.0, 1.0)))} JOIN {_some(w.TOY)} c ON src = c.state")
def transitions_zero_rate(spark, sf_dir):
    return _moves(spark, sf_dir, w.TOY, rates.uniform(w.TOY, up={"D": 2.0}, down={"C": 0.0})).select("src", "dst", "var", "up", "rate", "n")


@query(f"SELECT src, dst, CAST(round(log2(xor(src, dst))) AS INTEGER) AS var, dst > src AS up, n FROM {o.model_edges(w.ROWS, _some(w.ROWS))} JOIN {_some(w.ROWS)} c ON src = c.state")
def edge_var_direction(spark, sf_dir):
    """Which node an edge flips, and where to, from its ends alone."""
    e = _moves(spark, sf_dir, w.ROWS).select("src", "dst", "n")
    return e.select("src", "dst", bits.changed(F.col("src"), F.col("dst")).alias("var"), bits.goes_up(F.col("src"), F.col("dst")).alias("up"), "n")


@query(f"SELECT DISTINCT src, dst, var, up FROM {o.model_edges(w.ROWS, '(SELECT DISTINCT state FROM ' + o.ROW_STATES + ')')}")
def row_transitions(spark, sf_dir):
    """Transitions of the row states alone."""
    return transitions.successors(w.row_states(spark, sf_dir).distinct(), w.ROWS).select("src", "dst", "var", "up")


@query(f"SELECT src, dst, rate FROM {o.EVENTS}")
def event_transitions(spark, sf_dir):
    return w.event_chain(spark, sf_dir)


@query(f"SELECT src, dst, rate FROM {o.MASKS}")
def mask_transitions(spark, sf_dir):
    return w.mask_chain(spark, sf_dir)


@query(f"SELECT src, dst, rate FROM {o.NATIONS}")
def nation_transitions(spark, sf_dir):
    return w.nation_graph(spark, sf_dir)


@query(f"SELECT src, count(*) AS degree FROM {o.NATIONS} GROUP BY src")
def out_degree(spark, sf_dir):
    return transitions.out_degree(w.nation_graph(spark, sf_dir))


@query(f"""WITH e AS (SELECT * FROM {o.NATIONS}), v AS (SELECT src AS state FROM e UNION SELECT dst FROM e),
d AS (SELECT state, count(src) AS n FROM v LEFT JOIN e ON src = state GROUP BY state)
SELECT state, CAST(sum(n) OVER (ORDER BY state) - n AS BIGINT) AS "begin", CAST(sum(n) OVER (ORDER BY state) AS BIGINT) AS "end" FROM d""")
def csc_offsets(spark, sf_dir):
    e = w.nation_graph(spark, sf_dir)
    return transitions.column_offsets(e, graph.vertices_of(e))


@query(f"WITH e AS (SELECT * FROM {o.EVENTS}) SELECT dst AS \"row\", src AS col, rate AS value FROM e WHERE src <> dst UNION ALL SELECT src, src, -sum(rate) FROM e WHERE src <> dst GROUP BY src")
def kinetic_matrix(spark, sf_dir):
    return transitions.kinetic_matrix(w.event_chain(spark, sf_dir).where("src <> dst"))


@query(f"SELECT DISTINCT src AS col, CAST(0 AS DOUBLE) AS total FROM {o.EVENTS}")
def kinetic_column_sums(spark, sf_dir):
    k = transitions.kinetic_matrix(w.event_chain(spark, sf_dir).where("src <> dst"))
    return k.groupBy("col").agg(rounded(F.sum("value")).alias("total"))


@query(f"""WITH m AS (SELECT dst AS r, src AS c, rate AS value FROM {o.NATIONS}), v AS (SELECT r AS s FROM m UNION SELECT c FROM m),
g AS (SELECT s, s % 2 AS grp, row_number() OVER (PARTITION BY s % 2 ORDER BY s) - 1 AS i FROM v)
SELECT CAST(a.grp AS BIGINT) AS grp, CAST(a.i AS BIGINT) AS "row", CAST(b.i AS BIGINT) AS col, value FROM m JOIN g a ON r = a.s JOIN g b ON c = b.s WHERE a.grp = b.grp""")
def submatrix(spark, sf_dir):
    """The blocks of even and of odd nations."""
    e = w.nation_graph(spark, sf_dir)
    m = e.select(F.col("dst").alias("row"), F.col("src").alias("col"), F.col("rate").alias("value"))
    return transitions.submatrix(m, graph.vertices_of(e).withColumn("grp", F.col("state") % 2))


# --------------------------------------------------------------------------- graphs


def _nations(spark, sf_dir):
    e = keep(w.nation_graph(spark, sf_dir))
    return e, graph.vertices_of(e)


_G = o.with_graph(o.NATIONS)


@query(f"{_G} SELECT b AS state FROM reach WHERE a = 0")
def reach_forward(spark, sf_dir):
    e, v = _nations(spark, sf_dir)
    return graph.forward(e, v.where("state = 0"))


@query(f"{_G} SELECT a AS state FROM reach WHERE b = 1")
def reach_backward(spark, sf_dir):
    e, v = _nations(spark, sf_dir)
    return graph.backward(e, v.where("state = 1"))


@query(f"""WITH RECURSIVE e AS (SELECT * FROM {o.NATIONS}), u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
r(a, b) AS (SELECT a, a FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT a AS state, min(b) AS wcc FROM r GROUP BY a""")
def wcc(spark, sf_dir):
    return graph.weak_components(*_nations(spark, sf_dir))


@query(f"{_G} SELECT state, scc FROM scc")
def scc(spark, sf_dir):
    return graph.strong_components(*_nations(spark, sf_dir))


_SEEN = f"(SELECT src, dst, rate FROM {o.model_edges(w.ROWS, _some(w.ROWS))} WHERE dst IN (SELECT state FROM {o.ROW_STATES}))"


@query(f"{o.with_graph(_SEEN, '(SELECT DISTINCT state FROM ' + o.ROW_STATES + ')')} SELECT state, scc FROM scc")
def scc_model(spark, sf_dir):
    """Components of a model's transitions among the states of line items."""
    seen = keep(w.row_states(spark, sf_dir).distinct())
    inside = _moves(spark, sf_dir, w.ROWS).join(seen.withColumnRenamed("state", "dst"), "dst", "left_semi")
    return graph.strong_components(inside, seen)


@query(f"""{_G}, s AS (SELECT scc, count(*) AS size FROM scc GROUP BY scc)
SELECT scc, size, CAST(row_number() OVER (ORDER BY scc) - 1 AS BIGINT) AS number, CAST(sum(size) OVER (ORDER BY scc) - size AS BIGINT) AS "begin" FROM s""")
def scc_sizes(spark, sf_dir):
    return graph.component_sizes(graph.strong_components(*_nations(spark, sf_dir)))


@query(f"{_G}, s AS (SELECT scc, count(*) AS size FROM scc GROUP BY scc) SELECT size, count(*) AS components FROM s GROUP BY size ORDER BY size DESC LIMIT 9")
def scc_histogram(spark, sf_dir):
    return graph.size_histogram(graph.strong_components(*_nations(spark, sf_dir)))


@query(o.peeled(o.NATIONS, 26))
def trim_rounds(spark, sf_dir):
    return graph.trim_rounds(*_nations(spark, sf_dir))


@query(f"""{o.peeled(o.NATIONS, 26, only_with=True)}, {o.graph_items()}, z AS (SELECT scc, count(*) AS size FROM scc GROUP BY scc)
SELECT CASE WHEN size > 2 THEN 'larger component' WHEN size = 2 THEN 'component of two' WHEN scc.state IN (SELECT state FROM s26) THEN 'between cycles' ELSE 'trimmed' END AS kind, count(*) AS states
FROM scc JOIN z ON scc.scc = z.scc GROUP BY 1""")
def scc_statistics(spark, sf_dir):
    e, v = _nations(spark, sf_dir)
    return graph.trimmed_and_cyclic(e, graph.strong_components(e, v))


@query(f"WITH e AS (SELECT * FROM {o.EVENTS}) SELECT x.src AS a, x.dst AS b FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst")
def two_cycles(spark, sf_dir):
    return graph.two_cycles(w.event_chain(spark, sf_dir))


@query(f"{_G} SELECT src, dst FROM cond")
def condensation(spark, sf_dir):
    e, v = _nations(spark, sf_dir)
    return graph.condense(e, graph.strong_components(e, v))


@query(f"{_G} SELECT scc, level FROM lev")
def topo_levels(spark, sf_dir):
    e, v = _nations(spark, sf_dir)
    c = graph.strong_components(e, v)
    return graph.levels(graph.condense(e, c), c)


@query(f"{o.with_graph(o.MASKS)} SELECT scc, level FROM lev")
def topo_levels_dag(spark, sf_dir):
    e = w.mask_chain(spark, sf_dir)
    return graph.levels(e, graph.vertices_of(e).select(F.col("state").alias("scc")))


@query(f"{_G} SELECT scc FROM term")
def terminals(spark, sf_dir):
    e, v = _nations(spark, sf_dir)
    return graph.terminals(e, graph.strong_components(e, v))


@query(f"{_G} SELECT state, CAST(row_number() OVER (ORDER BY CASE WHEN level = 1 THEN 0 ELSE 1 END, -level, scc.scc, state) - 1 AS BIGINT) AS ord FROM scc JOIN lev ON scc.scc = lev.scc")
def vertex_order(spark, sf_dir):
    e, v = _nations(spark, sf_dir)
    c = graph.strong_components(e, v)
    return graph.vertex_order(c, graph.levels(graph.condense(e, c), c))


# --------------------------------------------------------------------------- matrices


def _event_matrix(spark, sf_dir):
    return w.event_chain(spark, sf_dir).select(F.col("dst").alias("row"), F.col("src").alias("col"), F.col("rate").alias("value"))


_M = f"WITH m AS (SELECT dst AS r, src AS c, rate AS x FROM {o.EVENTS})"


@query(f'{_M} SELECT a.r AS "row", b.c AS col, sum(a.x * b.x) AS value FROM m a JOIN m b ON a.c = b.r GROUP BY a.r, b.c')
def matmul(spark, sf_dir):
    m = _event_matrix(spark, sf_dir)
    return matrix.matmul(m, m)


@query(f"{_M} SELECT r AS idx, sum(x * (c + 1)) AS value FROM m GROUP BY r")
def matvec(spark, sf_dir):
    x = spark.range(5).select(F.col("id").alias("idx"), (F.col("id") + 1.0).alias("value"))
    return matrix.matvec(_event_matrix(spark, sf_dir), x)


@query(f'{_M} SELECT c AS "row", r AS col, x AS value FROM m')
def transpose(spark, sf_dir):
    return matrix.transpose(_event_matrix(spark, sf_dir))


@query(f'{_M} SELECT r - CASE WHEN r > 2 THEN 1 ELSE 0 END AS "row", c - CASE WHEN c > 2 THEN 1 ELSE 0 END AS col, x AS value FROM m WHERE r <> 2 AND c <> 2')
def minor(spark, sf_dir):
    return matrix.minor(_event_matrix(spark, sf_dir), 2)


@query(f'{_M} SELECT r AS "row", c AS col, x AS value FROM m UNION ALL SELECT c, r + 5, x FROM m')
def hstack(spark, sf_dir):
    m = _event_matrix(spark, sf_dir)
    return matrix.hstack(m, matrix.transpose(m), 5)


@query(f'{_M} SELECT r AS "row", c AS col, x AS value, row_number() OVER (ORDER BY r, c) - 1 AS place FROM m')
def rows_sorted(spark, sf_dir):
    """Entries in the order in which their partitions hold them."""
    held = matrix.sorted_rows(_event_matrix(spark, sf_dir)).withColumn("at", F.monotonically_increasing_id())
    return number(keep(held), ["at"], "place").select("row", "col", "value", "place")


@query(f"""{_G}, ordered AS (SELECT state, row_number() OVER (ORDER BY CASE WHEN level = 1 THEN 0 ELSE 1 END, -level, scc.scc, state) - 1 AS ord FROM scc JOIN lev ON scc.scc = lev.scc),
k AS (SELECT dst AS r, src AS c, rate AS x FROM e UNION ALL SELECT src, src, -sum(rate) FROM e GROUP BY src)
SELECT CAST(a.ord AS BIGINT) AS "row", CAST(b.ord AS BIGINT) AS col, x AS value FROM k JOIN ordered a ON r = a.state JOIN ordered b ON c = b.state""")
def matrix_in_vertex_order(spark, sf_dir):
    """The kinetic matrix with terminal components first and then from the sources down."""
    e, v = _nations(spark, sf_dir)
    c = keep(graph.strong_components(e, v))
    return matrix.permuted(transitions.kinetic_matrix(e), graph.vertex_order(c, graph.levels(graph.condense(e, c), c)))


@query(f"""{_M}, k AS (SELECT a // 2 AS grp, max(x) FILTER (WHERE r % 2 = 0 AND c % 2 = 0) AS p, max(x) FILTER (WHERE r % 2 = 0 AND c % 2 = 1) AS q,
  max(x) FILTER (WHERE r % 2 = 1 AND c % 2 = 0) AS s, max(x) FILTER (WHERE r % 2 = 1 AND c % 2 = 1) AS t FROM (SELECT *, r AS a FROM m) WHERE r // 2 = c // 2 AND r < 4 GROUP BY a // 2)
SELECT CAST(grp AS BIGINT) AS grp, CAST(2 AS BIGINT) AS n, {_r('coalesce(p, 0) * coalesce(t, 0) - coalesce(q, 0) * coalesce(s, 0)', 3)} AS det FROM k""")
def determinant_2x2(spark, sf_dir):
    m = _event_matrix(spark, sf_dir).where("floor(row / 2) = floor(col / 2) and row < 4")
    blocks = m.select(F.floor(F.col("row") / 2).cast("long").alias("grp"), (F.col("row") % 2).alias("row"), (F.col("col") % 2).alias("col"), "value")
    return matrix.determinants(blocks).select("grp", "n", rounded("det", 3).alias("det"))


# --------------------------------------------------------------------------- long run


@query(f"{o.with_graph(o.EVENTS)}{o.iterated('(SELECT scc AS g, scc AS state, 1.0 AS p FROM term)', STEPS)} SELECT g AS scc, state, {_r('p')} AS p FROM y WHERE i = {STEPS}")
def stationary(spark, sf_dir):
    s = solve.Structure.of(w.event_chain(spark, sf_dir), levels=False)
    return solve.stationary(s).select("scc", "state", rounded("p").alias("p"))


def _weighed(model) -> str:
    """SQL: a model's transitions, each faster by the share of line items in the state that it leaves."""
    return f"(SELECT src, dst, 1 + coalesce(n, 0) / (SELECT count(*) FROM lineitem) AS rate FROM {o.model_edges(model)} LEFT JOIN {_some(model)} c ON src = c.state)"


def _weighed_edges(spark, sf_dir, model) -> DataFrame:
    counted = _counted(spark, sf_dir, len(model.nodes))
    total = counted.agg(F.sum("n").alias("total"))  # one row
    shares = counted.join(F.broadcast(total)).select(F.col("state").alias("src"), (F.col("n") / F.col("total")).alias("share"))
    return w.model_edges(spark, model).join(shares, "src", "left").select("src", "dst", (1 + F.coalesce("share", F.lit(0.0))).alias("rate"))


@query(f"{o.with_graph(_weighed(w.RING), o.space(3))}{o.iterated('(SELECT scc AS g, scc AS state, 1.0 AS p FROM term)', STEPS)} SELECT g AS scc, state, {_r('p')} AS p FROM y WHERE i = {STEPS}")
def stationary_model(spark, sf_dir):
    s = solve.Structure.of(_weighed_edges(spark, sf_dir, w.RING), states.space(spark, 3), levels=False)
    return solve.stationary(s).select("scc", "state", rounded("p").alias("p"))


@query("""WITH v AS (SELECT 0 AS state UNION SELECT l_orderkey * 2 FROM lineitem UNION SELECT l_partkey * 2 + 1 FROM lineitem)
SELECT CAST(0 AS BIGINT) AS scc, CAST(state AS BIGINT) AS state, round(1 / (1 + state % 7) / (SELECT sum(1 / (1 + state % 7)) FROM v), 11) + 0.0 AS p FROM v""")
def stationary_large(spark, sf_dir):
    """A component beyond one block: orders and parts, whose links balance, so that its long-run shares are known."""
    s = solve.Structure.of(w.order_part_chain(spark, sf_dir), levels=False)
    return solve.stationary(s).select("scc", "state", rounded("p", 11).alias("p"))


def _absorption_sql(edges: str, vertices: str | None = None, steps: int = STEPS) -> str:
    start = "(SELECT state AS g, state, 1.0 AS p FROM v)"
    return f"{o.with_graph(edges, vertices)}{o.iterated(start, steps)} SELECT scc.scc, y.g AS state, {_r('sum(p)')} AS p FROM y JOIN scc ON y.state = scc.state JOIN term ON scc.scc = term.scc WHERE i = {steps} GROUP BY scc.scc, y.g"


@query(_absorption_sql(o.MASKS))
def absorption_dag(spark, sf_dir):
    return solve.absorption(solve.Structure.of(w.mask_chain(spark, sf_dir))).select("scc", "state", rounded("p").alias("p"))


@query(_absorption_sql(_weighed(w.TOY), o.space(3)))
def absorption_model(spark, sf_dir):
    return solve.absorption(solve.Structure.of(_weighed_edges(spark, sf_dir, w.TOY), states.space(spark, 3))).select("scc", "state", rounded("p").alias("p"))


@query(_absorption_sql(o.NATIONS))
def absorption_scc(spark, sf_dir):
    return solve.absorption(solve.Structure.of(w.nation_graph(spark, sf_dir))).select("scc", "state", rounded("p").alias("p"))


def _final_sql(edges: str, start: str, vertices: str | None = None, select: str = "", steps: int = STEPS, more: str = "") -> str:
    y = o.iterated(f"(SELECT 0 AS g, state, p FROM {start})", steps)
    return f"{o.with_graph(edges, vertices)}{y} SELECT {select or 'y.state'}, {_r('sum(p)')} AS p FROM y JOIN scc ON y.state = scc.state JOIN term ON scc.scc = term.scc WHERE i = {steps} {more} GROUP BY y.state"


_ROW_SHARES = f"(SELECT state, count(*) / sum(count(*)) OVER () AS p FROM {o.ROW_STATES} GROUP BY state)"
_ROWS_SPACE = o.space(5)


def _row_solver(spark, sf_dir) -> Solver:
    return Solver(spark, w.ROWS, initial=states.empirical(w.row_states(spark, sf_dir)))


@query(_final_sql(o.model_edges(w.ROWS), _ROW_SHARES, _ROWS_SPACE))
def flagship(spark, sf_dir):
    """Where a five-node model takes the states of all line items in the long run."""
    return _row_solver(spark, sf_dir).final.select("state", rounded("p").alias("p"))


_NAMES = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN (y.state >> {i}) & 1 = 1 THEN '{n}' END" for i, n in enumerate(w.ROWS.nodes)) + "], lambda x: x IS NOT NULL), ' --- ')"


@query(_final_sql(o.model_edges(w.ROWS), _ROW_SHARES, _ROWS_SPACE, f"y.state, CASE WHEN y.state = 0 THEN '<nil>' ELSE {_NAMES} END AS nodes"))
def final_decoded(spark, sf_dir):
    return _row_solver(spark, sf_dir).named().select("state", "nodes", rounded("p").alias("p"))


@query(_final_sql(o.NATIONS, o.SHARES, o.SHARES))
def final_distribution(spark, sf_dir):
    """Customers' nations followed to the nations that supply them, and on."""
    start = w.nation_shares(spark, sf_dir)
    s = solve.Structure.of(w.nation_graph(spark, sf_dir), start.select("state"))
    return solve.final_distribution(solve.terminal_mass(s, start), solve.stationary(s)).select("state", rounded("p").alias("p"))


@query(f"{_G}, z AS (SELECT scc, count(*) AS size FROM scc GROUP BY scc) SELECT state, scc.scc, size, level, TRUE AS same FROM scc JOIN lev ON scc.scc = lev.scc JOIN z ON scc.scc = z.scc")
def stored_graph(spark, sf_dir):
    """A graph stored and read again, and whether its relations are what was stored."""
    from stillwater.operators.storage import folder
    from stillwater.sources import store

    where, made = folder(spark), solve.Structure.of(w.nation_graph(spark, sf_dir))
    store.save(where, {"edges": made.edges, "states": made.states})
    found = store.load(spark, where)
    same = store.equal(found["edges"], made.edges) and store.equal(found["states"], made.states)
    return found["states"].select("state", "scc", "size", "level", F.lit(same).alias("same"))


def _first_masks(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    code = F.array_position(F.array(*map(F.lit, w.EVENT_TYPES)), F.col("event_type")) - 1
    e = w.table(spark, sf_dir, "events").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("r = 1")
    return states.empirical(e.select(F.pow(F.lit(2), code).cast("long").alias("state")))


_FIRST = f"(SELECT CAST(1 << ({o._CODE}) AS BIGINT) AS state, count(*) / sum(count(*)) OVER () AS p FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1 GROUP BY 1)"


@query(_final_sql(o.MASKS, _FIRST, _FIRST))
def requery_new_initial(spark, sf_dir):
    """Absorption is solved once; another initial distribution takes two joins."""
    start = _first_masks(spark, sf_dir)
    s = solve.Structure.of(w.mask_chain(spark, sf_dir), start.select("state"))
    mass = solve.mass_by_absorption(solve.absorption(s), start)
    return solve.final_distribution(mass, solve.stationary(s)).select("state", rounded("p").alias("p"))


@query(_final_sql(o.model_edges(w.ROWS, rates=tuple((2.0 if i == 1 else 1.0, 0.5 if i == 4 else 1.0) for i in range(5))), _ROW_SHARES, _ROWS_SPACE))
def requery_new_rates(spark, sf_dir):
    """The graph is stored by a first run with other rates, and reused."""
    from stillwater.operators.storage import folder

    where, start = folder(spark), states.empirical(w.row_states(spark, sf_dir))
    Solver(spark, w.ROWS, initial=start, store_at=where).structure  # noqa: B018
    again = Solver(spark, w.ROWS, rates.uniform(w.ROWS, up={"F": 2.0}, down={"Q": 0.5}), start, store_at=where)
    return again.final.select("state", rounded("p").alias("p"))


def _some_shares(model) -> str:
    return f"(SELECT state, n / (SELECT count(*) FROM lineitem) AS p FROM {_some(model)})"


@query(" UNION ALL ".join(f"SELECT '{n}' AS model_id, * FROM ({_final_sql(o.model_edges(m), _some_shares(m), o.space(len(m.nodes)))}) WHERE p > 0" for n, m in _MODELS))
def corpus_final(spark, sf_dir):
    """All models in one plan, each from the states that line items have of its nodes."""
    rows = spark.createDataFrame(list(corpus.rows_of(dict(_MODELS))), "model_id string, idx int, node string, factor string")
    sizes = spark.createDataFrame([(n, (1 << len(m.nodes)) - 1) for n, m in _MODELS], "model_id string, mask bigint")
    counted = w.row_states(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))  # one row
    start = counted.join(F.broadcast(sizes)).groupBy("model_id", F.col("state").bitwiseAND(F.col("mask")).alias("state")).agg(F.sum("n").alias("n"))
    start = start.join(F.broadcast(total)).select("model_id", "state", (F.col("n") / F.col("total")).alias("p"))
    return corpus.CorpusSolver(rows, start).final.select("model_id", "state", rounded("p").alias("p")).where("p > 0")


@query(f"""WITH y AS (SELECT *, o_orderpriority = '1-URGENT' AS urgent FROM orders WHERE extract('year' FROM o_orderdate) = 1995),
n AS (SELECT count(*) FILTER (urgent) AS total FROM y),
c AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last, count(*) FILTER (urgent) AS k FROM y GROUP BY o_custkey)
SELECT CAST(last AS BIGINT) AS state, {_r('k / total', 9)} AS p FROM c, n WHERE k > 0""")
def final_by_weak_component(spark, sf_dir):
    """A chain of many weak components, of which only those that hold probability are solved."""
    return solve.long_run(*w.next_orders(spark, sf_dir)).select("state", rounded("p", 9).alias("p"))
