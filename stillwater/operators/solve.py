"""Long-run behaviour of a chain given by edges (src, dst, rate): stationary distributions of terminal components,
probabilities of absorption, and where an initial distribution ends.

Components are solved level by level, terminals first for absorption, sources first for distributions. Edges lie in a
folder for each level, and what a level gives to others is written by their level, so each edge is read once. A component
of one state is a weighted mean and one of two a closed form, both in SQL; larger ones are dense blocks, many small ones to
a task. Beyond DENSE states a terminal component whose rates balance is solved by quotients of rates (balance.py), and any other
component is eliminated state by state and block by block (elimination.py). All of this adds, multiplies and divides numbers
that are not negative, and never subtracts, so values keep their digits however rare moves are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.operators import balance, elimination, graph
from stillwater.operators.elimination import Elimination
from stillwater.operators.matrix import dense
from stillwater.operators.storage import Pile, Shelves, keep, measured

#: States of a component that one task solves as a dense block: 3,000 take 72 MB. Blocks of larger ones have half as many.
DENSE = 3_000
#: States of small components that one task solves.
PACK = 4_096


@dataclass
class Structure:
    """What the edges say whatever the numbers on them: states with their component, its size and level; edges inside and
    between components."""

    edges: DataFrame  # src, dst, rate
    states: DataFrame  # state, scc, size, level
    top: int
    _eliminations: dict[int, Elimination] = field(default_factory=dict)

    @classmethod
    def of(cls, edges: DataFrame, states: DataFrame | None = None, levels: bool = True) -> Structure:
        """states: those to know besides the edges' own; a state without edges is a terminal of its own. Without levels,
        level only tells terminals (1) from other components (2), which is all that stationary() needs."""
        edges = keep(edges.where("src <> dst and rate > 0").groupBy("src", "dst").agg(F.sum("rate").alias("rate")))
        known = graph.vertices_of(edges) if states is None else graph.vertices_of(edges).union(states.select("state")).distinct()
        scc = keep(graph.strong_components(edges, keep(known)))
        condensed = graph.condense(edges, scc)
        if levels:
            level = graph.levels(condensed, scc)
        else:
            level = scc.select("scc").distinct().join(condensed.select(F.col("src").alias("scc")).distinct().withColumn("level", F.lit(2).cast("long")), "scc", "left").na.fill(1, ["level"])
        sizes = scc.groupBy("scc").agg(F.count("*").alias("size"))
        table, seen = measured(scc.join(sizes, "scc").join(level, "scc").select("state", "scc", "size", "level"), F.max("level").alias("top"))
        return cls(edges, table, seen["top"] or 0)

    def extended(self, edges: DataFrame, states: DataFrame) -> Structure:
        """With further states and the edges that leave them. No known state may lead to these, so its component and level stay:
        only the further ones are decomposed."""
        edges = keep(edges.where("src <> dst and rate > 0").groupBy("src", "dst").agg(F.sum("rate").alias("rate")))
        new = keep(states.select("state").distinct())
        scc = keep(graph.strong_components(edges.join(new.withColumnRenamed("state", "dst"), "dst", "left_semi").select("src", "dst"), new))
        condensed = keep(graph.condense(edges, self.states.select("state", "scc").unionByName(scc.select("state", "scc"))))
        known = self.states.select(F.col("scc").alias("dst"), "level").distinct()
        base = condensed.join(known, "dst").groupBy(F.col("src").alias("scc")).agg((F.max("level") + 1).alias("base"))
        level = graph.levels(condensed.join(known, "dst", "left_anti"), scc, base)
        sizes = scc.groupBy("scc").agg(F.count("*").alias("size"))
        table, seen = measured(scc.join(sizes, "scc").join(level, "scc").select("state", "scc", "size", "level"), F.max("level").alias("top"))
        return Structure(self.edges.select("src", "dst", "rate").unionByName(edges), self.states.unionByName(table), max(self.top, seen["top"] or 0))

    @property
    def terminals(self) -> DataFrame:
        return self.states.where("level = 1").select("state", "scc", "size")

    @cached_property
    def _detailed(self) -> DataFrame:
        """src, dst, rate, total (of src), and component (own, other), size and level (from, to) of both ends."""
        total = self.edges.groupBy(F.col("src").alias("state")).agg(F.sum("rate").alias("total"))
        one = self.states.join(total, "state").select(F.col("state").alias("src"), "total", F.col("scc").alias("own"), "size", F.col("level").alias("from"))
        two = self.states.select(F.col("state").alias("dst"), F.col("scc").alias("other"), F.col("size").alias("to_size"), F.col("level").alias("to"))
        return self.edges.join(one, "src").join(two, "dst").select("src", "dst", "rate", "total", "own", "size", "from", "other", "to_size", "to")

    @cached_property
    def leaving(self) -> Shelves:
        """Edges by the level they leave."""
        return Shelves(self._detailed, "from")

    @cached_property
    def arriving(self) -> Shelves:
        """Edges between components by the level they lead to."""
        return Shelves(self._detailed.where("own <> other"), "to")

    def eliminated(self, level: int, only: DataFrame | None = None) -> Elimination:
        """The components of a level with more than DENSE states, or of these `only` some (own), eliminated once for all that is
        asked of them."""
        if level not in self._eliminations:
            here = self.leaving.of(level).where(F.col("size") > DENSE)
            here = here if only is None else here.join(only, "own", "left_semi")
            leaks = here.where("own <> other").groupBy("own", F.col("src").alias("state")).agg(F.sum("rate").alias("rate"))
            self._eliminations[level] = Elimination.of(here.where("own = other").select("own", "src", "dst", "rate"), leaks, DENSE)
        return self._eliminations[level]

    @cached_property
    def kinds(self) -> dict[int, set[str]]:
        """Which ways of solving each level needs."""
        kind = F.when(F.col("size") == 1, "one").when(F.col("size") == 2, "two").when(F.col("size") <= DENSE, "block").otherwise("large")
        out: dict[int, set[str]] = {}
        for level, name in self.states.select("level", kind).distinct().collect():  # four rows a level at most
            out.setdefault(level, set()).add(name)
        return out


def _bins(sizes: DataFrame) -> DataFrame:
    """own, size -> with bin: components of up to 64 states share bins of about PACK states, larger ones have their own."""
    small = F.col("size") <= 64
    states = sizes.where(small).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shared = F.pmod(F.xxhash64("own"), F.lit(max(1, -(-states // PACK))))
    return keep(sizes.select("own", F.when(small, -1 - shared).otherwise(F.hash("own").cast("long") * (1 << 20) + F.pmod("own", F.lit(1 << 20))).alias("bin")))


def _each(left, right, solve: Callable, key: str):
    """solve(rows of left, rows of right) for each component in a bin, as one frame."""
    import pandas as pd

    rights = dict(list(right.groupby("own")))
    none = right.iloc[:0]
    return pd.concat([solve(own, part, rights.get(own, none)) for own, part in left.groupby("own")], ignore_index=True)


def _system(part) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """The states of a block, the inverse of D - rates, D being all that leaves each, and each state's place. part: edges that
    leave its states."""
    names, index = np.unique(part["src"], return_inverse=True)
    place = {x: i for i, x in enumerate(names.tolist())}
    to = np.array([place.get(x, -1) for x in part["dst"].tolist()])
    rate = part["rate"].to_numpy()
    out = np.bincount(index[to < 0], rate[to < 0], minlength=len(names))
    return names, elimination.inverse(dense(index[to >= 0], to[to >= 0], rate[to >= 0], len(names)), out), place


# --------------------------------------------------------------------------- terminal components


def stationary(s: Structure) -> DataFrame:
    """scc, state, p for each state of a terminal component."""
    members = s.terminals
    kinds = s.kinds.get(1, set())
    out = members.where("size = 1").select("scc", "state", F.lit(1.0).alias("p"))
    inside = s.edges.join(members.where("size > 1").select(F.col("state").alias("src"), F.col("scc").alias("own"), "size"), "src")
    if "two" in kinds:  # each state's share is as the other's rate
        pair = inside.where("size = 2").withColumn("sum", F.sum("rate").over(_of("own")))
        out = out.unionByName(pair.select(F.col("own").alias("scc"), F.col("dst").alias("state"), (F.col("rate") / F.col("sum")).alias("p")))
    if "block" in kinds:

        def block(key, pdf):
            import pandas as pd

            done = []
            for own, part in pdf.groupby("own"):
                names, index = np.unique(np.concatenate([part["src"], part["dst"]]), return_inverse=True)
                m = len(part)
                done.append(pd.DataFrame({"scc": own, "state": names, "p": _shares(dense(index[:m], index[m:], part["rate"], len(names)))}))
            return pd.concat(done, ignore_index=True)

        some = F.col("size").between(3, DENSE)
        bins = _bins(members.where(some).select(F.col("scc").alias("own"), "size").distinct())
        out = out.unionByName(inside.where(some).join(bins, "own").groupBy("bin").applyInPandas(block, "scc bigint, state bigint, p double"))
    if "large" in kinds:
        large = F.col("size") > DENSE
        chains = members.where(large).select(F.col("scc").alias("own"), "size").distinct()
        shares, others = balance.shares(inside.where(large).select("own", "src", "dst", "rate"), chains)
        out = out.unionByName(shares.select(F.col("own").alias("scc"), "state", "p"))
        if not others.isEmpty():
            out = out.unionByName(s.eliminated(1, others).stationary().select(F.col("own").alias("scc"), "state", "p"))
    return out


def _of(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)


def _shares(rates: np.ndarray) -> np.ndarray:
    p = elimination.stationary(rates)
    return p / p.sum()


# --------------------------------------------------------------------------- absorption


def absorption(s: Structure) -> DataFrame:
    """scc (of a terminal component), state, p: the probability that the chain ends in it when started in the state. For
    each state these sum up to 1. A level's probabilities are passed on to the states with edges to it."""
    out = Pile(s.terminals.select("scc", "state", F.lit(1.0).alias("p")))
    passed = Shelves(_pass_on(s, 1, out.all), "from") if s.top > 1 else None
    for level in range(2, s.top + 1):
        inflow = passed.of(level).groupBy("own", "size", "src", "total", "scc").agg(F.sum("b").alias("b"))
        parts, kinds = [], s.kinds.get(level, set())
        if "one" in kinds:
            parts.append(inflow.where("size = 1").select("scc", F.col("src").alias("state"), (F.col("b") / F.col("total")).alias("p")))
        if len(kinds) > 1 or "one" not in kinds:
            inflow = keep(inflow.where("size > 1"))
            inside = s.leaving.of(level).where("size > 1")
            parts += [solve(inside, inflow) for name, solve in (("two", _absorb_pairs), ("block", _absorb_blocks)) if name in kinds]
            if "large" in kinds:
                right = inflow.where(F.col("size") > DENSE).select("own", F.col("src").alias("state"), F.col("scc").alias("col"), F.col("b").alias("value"))
                parts.append(s.eliminated(level).solve(right, transposed=False).select(F.col("col").alias("scc"), "state", F.col("value").alias("p")))
        new = out.add(_union(parts))
        if level < s.top:
            passed.add(_pass_on(s, level, new))
    return out.all


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _pass_on(s: Structure, level: int, x: DataFrame) -> DataFrame:
    """What states with edges to a level get from its probabilities: own, size, src, total, from, scc, b."""
    met = s.arriving.of(level).join(x.withColumnRenamed("state", "dst"), "dst")
    return met.groupBy("own", "size", "src", "total", "from", "scc").agg(F.sum(F.col("rate") * F.col("p")).alias("b"))


def _pairs(edges: DataFrame) -> DataFrame:
    """own, a, b (the states of each component of two), ab, ba (the rates between them), ta, tb (all rates out), and det, the
    determinant of the system, as a sum of positive terms."""
    two = edges.where("size = 2")
    first, inside = F.col("src") == F.col("own"), F.col("own") == F.col("other")  # a component has its least state's name
    one = two.groupBy("own").agg(
        F.max(F.when(~first, F.col("src"))).alias("b"), F.sum(F.when(first & inside, F.col("rate"))).alias("ab"), F.sum(F.when(~first & inside, F.col("rate"))).alias("ba"),
        F.coalesce(F.sum(F.when(first & ~inside, F.col("rate"))), F.lit(0.0)).alias("ea"), F.coalesce(F.sum(F.when(~first & ~inside, F.col("rate"))), F.lit(0.0)).alias("eb"),
    )
    det = F.col("ab") * F.col("eb") + F.col("ea") * F.col("ba") + F.col("ea") * F.col("eb")
    return one.select("own", F.col("own").alias("a"), "b", "ab", "ba", (F.col("ab") + F.col("ea")).alias("ta"), (F.col("ba") + F.col("eb")).alias("tb"), det.alias("det"))


def _absorb_pairs(edges: DataFrame, inflow: DataFrame) -> DataFrame:
    b = inflow.where("size = 2").groupBy("own", "scc").agg(F.coalesce(F.sum(F.when(F.col("src") == F.col("own"), F.col("b"))), F.lit(0.0)).alias("va"), F.coalesce(F.sum(F.when(F.col("src") != F.col("own"), F.col("b"))), F.lit(0.0)).alias("vb"))
    both = _pairs(edges).join(b, "own")
    one = F.struct(F.col("a").alias("state"), ((F.col("va") * F.col("tb") + F.col("ab") * F.col("vb")) / F.col("det")).alias("p"))
    two = F.struct(F.col("b").alias("state"), ((F.col("vb") * F.col("ta") + F.col("ba") * F.col("va")) / F.col("det")).alias("p"))
    return both.select("scc", F.explode(F.array(one, two)).alias("x")).select("scc", "x.state", "x.p")


def _absorb_blocks(edges: DataFrame, inflow: DataFrame) -> DataFrame:
    """(total - rates inside) x = b for all right sides of each component at once."""

    def one(own, part, right):
        import pandas as pd

        names, w, place = _system(part)
        targets, column = np.unique(right["scc"], return_inverse=True)
        b = np.zeros((len(names), len(targets)))
        b[[place[x] for x in right["src"].tolist()], column] = right["b"]
        return pd.DataFrame({"scc": np.tile(targets, len(names)), "state": np.repeat(names, len(targets)), "p": (w @ b).ravel()})

    some = F.col("size").between(3, DENSE)
    bins = _bins(edges.where(some).select("own", "size").distinct())
    left = edges.where(some).select("own", "src", "dst", "rate", "total").join(bins, "own")
    right = inflow.where(some).select("own", "src", "scc", "b").join(bins.withColumnRenamed("bin", "to_bin"), "own")
    return left.groupBy("bin").cogroup(right.groupBy("to_bin")).applyInPandas(lambda key, l, r: _each(l, r, one, "own"), "scc bigint, state bigint, p double")


# --------------------------------------------------------------------------- distributions


def terminal_mass(s: Structure, initial: DataFrame) -> DataFrame:
    """scc, p: how much of initial(state, p) ends in each terminal component. One right side is pushed forward, level by
    level from the sources, which is less work than absorption() of all states."""
    start = initial.where("p > 0").join(s.states, "state").select("state", "scc", "level", "p")
    mass = Shelves(start, "level")
    for level in range(s.top, 1, -1):
        here = s.leaving.of(level)
        arrived = mass.of(level).groupBy(F.col("state").alias("src"), F.col("scc").alias("own")).agg(F.sum("p").alias("b"))
        parts, kinds = [], s.kinds.get(level, set())
        if "one" in kinds:
            parts.append(here.where("size = 1").join(arrived.drop("own"), "src").select("dst", "other", "to", (F.col("rate") / F.col("total") * F.col("b")).alias("p")))
        if len(kinds) > 1 or "one" not in kinds:
            arrived, inner = keep(arrived), here.where("size > 1")
            visits = [solve(inner, arrived) for name, solve in (("two", _visit_pairs), ("block", _visit_blocks)) if name in kinds]
            if "large" in kinds:
                right = arrived.join(inner.where(F.col("size") > DENSE).select("own").distinct(), "own", "left_semi").select("own", F.col("src").alias("state"), F.lit(0).cast("long").alias("col"), F.col("b").alias("value"))
                visits.append(s.eliminated(level).solve(right, transposed=True).select(F.col("state").alias("src"), F.col("value").alias("z")))
            visits = _union(visits)
            parts.append(inner.where("own <> other").join(visits, "src").select("dst", "other", "to", (F.col("rate") * F.col("z")).alias("p")))
        onward = _union(parts).groupBy("dst", "other", "to").agg(F.sum("p").alias("p"))
        mass.add(onward.select(F.col("dst").alias("state"), F.col("other").alias("scc"), F.col("to").alias("level"), "p"))
    return mass.of(1).groupBy("scc").agg(F.sum("p").alias("p"))


def _visit_pairs(edges: DataFrame, arrived: DataFrame) -> DataFrame:
    b = arrived.groupBy("own").agg(F.coalesce(F.sum(F.when(F.col("src") == F.col("own"), F.col("b"))), F.lit(0.0)).alias("va"), F.coalesce(F.sum(F.when(F.col("src") != F.col("own"), F.col("b"))), F.lit(0.0)).alias("vb"))
    both = _pairs(edges).join(b, "own")
    one = F.struct(F.col("a").alias("src"), ((F.col("va") * F.col("tb") + F.col("ba") * F.col("vb")) / F.col("det")).alias("z"))
    two = F.struct(F.col("b").alias("src"), ((F.col("vb") * F.col("ta") + F.col("ab") * F.col("va")) / F.col("det")).alias("z"))
    return both.select(F.explode(F.array(one, two)).alias("x")).select("x.src", "x.z")


def _visit_blocks(edges: DataFrame, arrived: DataFrame) -> DataFrame:
    """z with z_i total_i = b_i + sum of z_j rate(j, i) inside each component: src, z."""

    def one(own, part, right):
        import pandas as pd

        if not len(right):
            return pd.DataFrame({"src": np.zeros(0, np.int64), "z": np.zeros(0)})
        names, w, place = _system(part)
        b = np.zeros(len(names))
        np.add.at(b, [place[x] for x in right["src"].tolist()], right["b"])
        return pd.DataFrame({"src": names, "z": b @ w})

    some = F.col("size").between(3, DENSE)
    bins = _bins(edges.where(some).select("own", "size").distinct())
    left = edges.where(some).select("own", "src", "dst", "rate", "total").join(bins, "own")
    right = arrived.join(bins.withColumnRenamed("bin", "to_bin"), "own")
    return left.groupBy("bin").cogroup(right.groupBy("to_bin")).applyInPandas(lambda key, l, r: _each(l, r, one, "own"), "src bigint, z double")


def final_distribution(mass: DataFrame, stationary_: DataFrame) -> DataFrame:
    """terminal_mass() and stationary() -> state, p of the states that keep any probability."""
    return stationary_.withColumnRenamed("p", "share").join(mass, "scc").where("p > 0").select("state", (F.col("share") * F.col("p")).alias("p"))


def mass_by_absorption(absorption_: DataFrame, initial: DataFrame) -> DataFrame:
    """The same as terminal_mass(), from stored absorption probabilities: two joins for any new initial distribution."""
    return absorption_.withColumnRenamed("p", "a").join(initial, "state").groupBy("scc").agg(F.sum(F.col("a") * F.col("p")).alias("p"))


def with_mass(edges: DataFrame, initial: DataFrame, states: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The edges and the states (state) of the weak components that hold any of initial(state, p): no other state ever gets
    probability, so no other is decomposed or solved."""
    known = graph.vertices_of(edges).union(initial.select("state")) if states is None else graph.vertices_of(edges).union(states.select("state")).union(initial.select("state"))
    wcc = keep(graph.weak_components(edges.select("src", "dst"), known.distinct()))
    holding = wcc.join(initial.where("p > 0").select("state"), "state", "left_semi").select("wcc").distinct()
    kept = keep(wcc.join(holding, "wcc", "left_semi").select("state"))
    return edges.join(kept.withColumnRenamed("state", "src"), "src", "left_semi"), kept


def long_run(edges: DataFrame, initial: DataFrame) -> DataFrame:
    """state, p: where initial(state, p) ends along edges (src, dst, rate)."""
    s = Structure.of(*with_mass(edges, initial))
    return final_distribution(terminal_mass(s, initial), stationary(s))
