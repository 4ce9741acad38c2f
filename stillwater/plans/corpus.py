"""Many models in one plan: the states of all of them are one table, told apart by their model's number, so that one closure,
one search for components and one solution serve a whole corpus. The number of Spark jobs does not grow with the models.

A state of a model is one BIGINT: the model's number times 2^NODES, and the model's own bit mask. Rules are arrays of clause
masks in a row for each model, which the states join by number; whether a rule holds is an expression over these arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwater.functions import bits
from stillwater.operators import graph, solve
from stillwater.operators.numbering import number
from stillwater.operators.storage import keep
from stillwater.sources.models import parse_model

#: Nodes of a model at most; there may be 2^22 models.
NODES = 40

_MODELS = "model_id string, nodes array<string>, rules array<array<struct<p: bigint, n: bigint>>>"


def models_table(corpus: DataFrame) -> DataFrame:
    """(model_id, idx, node, factor) -> model_id, nodes, rules (for each node the masks of its clauses) and number. Models are
    parsed where their rows lie."""

    def parse(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        model = parse_model("\n".join(f"{n},{f}" for n, f in zip(rows["node"], rows["factor"], strict=True)))
        if len(model.nodes) > NODES:
            raise ValueError(f"{key[0]} has {len(model.nodes)} nodes, more than {NODES}")
        return pd.DataFrame({"model_id": [key[0]], "nodes": [list(model.nodes)], "rules": [[[{"p": p, "n": n} for p, n in model.clause_masks(x)] for x in model.nodes]]})

    parsed = keep(corpus.select("model_id", "idx", "node", "factor").groupBy("model_id").applyInPandas(parse, _MODELS))
    return keep(number(parsed, ["model_id"], "number"))


def state_of(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << NODES) - 1))


def model_of(key: Column) -> Column:
    return F.shiftright(key, NODES)


def successors(states: DataFrame, models: DataFrame) -> DataFrame:
    """states(state: of any models) -> src, dst, rate. models: models_table(), and up and down (array<double>) if rates are not all 1."""
    rated = "up" in models.columns
    joined = states.withColumn("number", model_of(F.col("state"))).join(models.select("number", "rules", *(["up", "down"] if rated else [])), "number")
    s = state_of(F.col("state"))

    def move(rule: Column, i: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), i)
        on = s.bitwiseAND(bit) != F.lit(0)
        target = F.exists(rule, lambda c: bits.matches(s, c["p"], c["n"]))
        rate = F.when(on, F.get("down", i)).otherwise(F.get("up", i)) if rated else F.lit(1.0)
        return F.when(on != target, F.struct(F.col("state").bitwiseXOR(bit).alias("dst"), rate.alias("rate")))

    moves = joined.select(F.col("state").alias("src"), F.explode(F.array_compact(F.transform("rules", move))).alias("m"))
    return moves.select("src", "m.dst", "m.rate").where("rate > 0")


class CorpusSolver:
    """The chains of all models from their start distributions.

    corpus: (model_id, idx, node, factor), as read_corpus() gives them. start: (model_id, state, p). rates: (model_id, node, up,
    down), 1 where a node has none."""

    def __init__(self, corpus: DataFrame, start: DataFrame, rates: DataFrame | None = None):
        self.models = models_table(corpus)
        if rates is not None:
            self.models = keep(self._rated(rates))
        names = self.models.select("model_id", "number")
        self.start = keep(start.where("p > 0").join(names, "model_id").select((F.shiftleft(F.col("number"), NODES) + F.col("state")).alias("state"), "p"))

    def _rated(self, rates: DataFrame) -> DataFrame:
        places = self.models.select("number", "model_id", F.posexplode("nodes").alias("i", "node"))
        both = places.join(rates, ["model_id", "node"], "left").groupBy("number").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("up", F.lit(1.0)).alias("up"), F.coalesce("down", F.lit(1.0)).alias("down")))).alias("r"))  # a model's nodes
        return self.models.join(both, "number").select(*self.models.columns, F.col("r.up").alias("up"), F.col("r.down").alias("down"))

    @cached_property
    def reached(self) -> DataFrame:
        return graph.closure(self.start.select("state"), lambda at: successors(at, self.models).select(F.col("dst").alias("state")))

    @cached_property
    def structure(self) -> solve.Structure:
        return solve.Structure.of(successors(self.reached, self.models), self.reached)

    @cached_property
    def final(self) -> DataFrame:
        """model_id, state, nodes (names of those on), p"""
        found = solve.final_distribution(solve.terminal_mass(self.structure, self.start), solve.stationary(self.structure))
        named = found.withColumn("number", model_of(F.col("state"))).join(self.models.select("number", "model_id", F.col("nodes").alias("names")), "number")
        s = state_of(F.col("state"))
        on = F.filter("names", lambda _, i: s.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != F.lit(0))
        return keep(named.select("model_id", s.alias("state"), F.when(s == F.lit(0), F.lit("<nil>")).otherwise(F.array_join(on, " --- ")).alias("nodes"), "p"))


def rows_of(models: dict) -> Iterator[tuple[str, int, str, str]]:
    """Models as rows (model_id, idx, node, factor)."""
    from stillwater.functions import boolean

    for name, model in models.items():
        for i, (node, rule) in enumerate(zip(model.nodes, model.rules, strict=True)):
            yield name, i, node, boolean.text_of(rule)
