"""A model's way from rules to its long-run distribution, with stored results reused."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwater.functions import bits
from stillwater.operators import graph, solve, states, transitions
from stillwater.operators import rates as rates_
from stillwater.operators.rates import Rates
from stillwater.operators.storage import keep
from stillwater.sources import store
from stillwater.sources.models import BooleanModel, models_of, read_corpus


class Solver:
    """The chain of a model and its rates from initial distributions.

    Only states that the initial distribution reaches are built, unless `everything` asks for all of them: no other
    state ever gets probability. store_at: a folder in shared storage; the graph of what was reached is then kept for all
    rates with the same zeros, and the solution for these rates. Another initial distribution reads both if it starts from
    stored states; else the graph is extended by what its other states reach, which is stored as a further part.
    """

    def __init__(self, spark: SparkSession, model: BooleanModel, rates: Rates | None = None, initial: DataFrame | None = None, everything: bool = False, store_at: str | None = None):
        self.spark, self.model = spark, model
        self.rates = rates or rates_.uniform(model)
        self.initial = states.uniform(spark, model) if initial is None else initial
        self.everything, self.store_at = everything, store_at
        self.reused: list[str] = []
        self._parts = 0

    @cached_property
    def reached(self) -> DataFrame:
        if self.everything:
            return states.space(self.spark, len(self.model.nodes))
        start = self.initial.where("p > 0").select("state")
        return graph.closure(start, lambda at: transitions.successors(at, self.model, self.rates).select(F.col("dst").alias("state")))

    @cached_property
    def edges(self) -> DataFrame:
        """src, dst, var, up, rate"""
        return transitions.successors(self.reached, self.model, self.rates)

    @cached_property
    def structure(self) -> solve.Structure:
        if not self.store_at:
            return solve.Structure.of(self.edges, self.reached)
        folder = store.graph_folder(self.store_at, self.model, self.rates)
        parts = store.load_parts(self.spark, folder)
        self._parts = len(parts)
        if not parts:
            made = solve.Structure.of(self.edges, self.reached)
            return self._stored(folder, made, made.edges, made.states)
        self.reused.append("graph")
        table, pairs = parts[0]["states"], parts[0]["edges"]
        for p in parts[1:]:
            table, pairs = table.unionByName(p["states"]), pairs.unionByName(p["edges"])
        known = solve.Structure(keep(pairs.withColumn("rate", self._rate())), table, table.agg(F.max("level")).first()[0] or 0)
        start = self.reached if self.everything else self.initial.where("p > 0").select("state")
        new = keep(start.join(table.select("state"), "state", "left_anti").select("state").distinct())
        if new.isEmpty():
            return known
        # What is stored is closed: steps from it lead nowhere else.
        step = lambda at: transitions.successors(at, self.model, self.rates).select(F.col("dst").alias("state")).join(table.select("state"), "state", "left_anti")
        further = graph.closure(new, step)
        made = known.extended(transitions.successors(further, self.model, self.rates), further)
        return self._stored(folder, made, made.edges.join(further.withColumnRenamed("state", "src"), "src", "left_semi"), made.states.join(further, "state", "left_semi"))

    def _rate(self):
        """The rate of an edge, from its ends."""
        up, down = (F.create_map(*[F.lit(x) for i, r in enumerate(self.rates) for x in (i, float(r[k]))]) for k in (0, 1))
        var = bits.changed(F.col("src"), F.col("dst"))
        return F.when(bits.goes_up(F.col("src"), F.col("dst")), up[var]).otherwise(down[var])

    def _stored(self, folder: str, made: solve.Structure, edges: DataFrame, table: DataFrame) -> solve.Structure:
        store.save(f"{folder}/{self._parts}", {"edges": edges.select("src", "dst"), "states": table.select("state", "scc", "size", "level")})
        self._parts += 1
        return made

    @cached_property
    def _numbers(self) -> dict[str, DataFrame]:
        structure = self.structure  # tells how many parts there are
        folder = self.store_at and store.numbers_folder(self.store_at, self.model, self.rates, self._parts)
        found = store.load(self.spark, folder) if folder else None
        if found is not None:
            self.reused.append("solution")
            return found
        made = {"stationary": keep(solve.stationary(structure)), "absorption": solve.absorption(structure)}
        if folder:
            store.save(folder, made)
        return made

    @cached_property
    def stationary(self) -> DataFrame:
        """scc, state, p"""
        return self._numbers["stationary"] if self.store_at else keep(solve.stationary(self.structure))

    @cached_property
    def absorption(self) -> DataFrame:
        """scc, state, p"""
        return self._numbers["absorption"]

    @cached_property
    def terminal_mass(self) -> DataFrame:
        """scc, p"""
        if self.store_at:
            return keep(solve.mass_by_absorption(self.absorption, self.initial))
        return keep(solve.terminal_mass(self.structure, self.initial))

    @cached_property
    def final(self) -> DataFrame:
        """state, p"""
        return keep(solve.final_distribution(self.terminal_mass, self.stationary))

    def named(self, separator: str = " --- ") -> DataFrame:
        """state, nodes, p, by state"""
        return self.final.select("state", bits.decode(F.col("state"), list(self.model.nodes), separator).alias("nodes"), "p").orderBy("state")


def solve_corpus(spark: SparkSession, pattern: str, fixed: dict[str, dict[str, int]] | None = None) -> Iterator[tuple[str, Solver]]:
    """A solver for each model of the files that match, one after another; its result is computed when asked for. fixed: start
    values of nodes by model; a model without any starts from all its states alike."""
    for model_id, model in models_of(read_corpus(spark, pattern)):
        start = (fixed or {}).get(model_id)
        yield model_id, Solver(spark, model, initial=states.fixed(spark, model, start) if start else None)
