"""Transitions of a model, weighted edges, and the kinetic matrix.

A node that its rule would turn on goes up, one that it would turn off goes down, one node at a time. Edges with
rate 0 do not exist. All edges of a state come from one narrow projection; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwater.functions import bits, boolean
from stillwater.operators.numbering import number, running
from stillwater.operators.rates import Rates
from stillwater.operators.storage import keep
from stillwater.sources.models import BooleanModel


def rule_value(model: BooleanModel, i: int, state: Column) -> Column:
    return boolean.column(model.rules[i], lambda name: bits.bit(state, model.place[name]))


def clause_value(masks: list[tuple[int, int]], state: Column) -> Column:
    """Whether any clause of two masks holds."""
    out = F.lit(False)
    for p, n in masks:
        out = out | bits.matches(state, F.lit(p).cast("long"), F.lit(n).cast("long"))
    return out


def successors(states: DataFrame, model: BooleanModel, rates: Rates | None = None) -> DataFrame:
    """states(state) -> src, dst, var, up, rate."""
    s = F.col("state")
    rates = rates or tuple((1.0, 1.0) for _ in model.nodes)
    moves = []
    for i, (up, down) in enumerate(rates):
        if up == 0 and down == 0 or i in model.inputs:
            continue
        on, target = bits.bit(s, i), rule_value(model, i, s)
        rises, falls = ~on & target, on & ~target
        happens = rises if down == 0 else falls if up == 0 else on != target
        rate = F.when(on, F.lit(float(down))).otherwise(F.lit(float(up)))
        moves.append(F.when(happens, F.struct(bits.flip(s, i).alias("dst"), F.lit(i).alias("var"), (~on).alias("up"), rate.alias("rate"))))
    if not moves:
        return states.select(s.alias("src"), s.alias("dst"), F.lit(0).alias("var"), F.lit(True).alias("up"), F.lit(0.0).alias("rate")).limit(0)
    one = states.select(s.alias("src"), F.explode(F.array_compact(F.array(*moves))).alias("m"))
    return one.select("src", "m.dst", "m.var", "m.up", "m.rate")


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def column_offsets(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """state, begin, end: where each state's edges stand when all are sorted by src."""
    degree = vertices.join(out_degree(edges), F.col("state") == F.col("src"), "left").select("state", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    return running(degree, ["state"], {"begin": "degree"}).select("state", "begin", (F.col("begin") + F.col("degree")).alias("end"))


def kinetic_matrix(edges: DataFrame) -> DataFrame:
    """(src, dst, rate) -> row, col, value: rates from column to row, and minus each column's sum on the diagonal."""
    off = edges.select(F.col("dst").alias("row"), F.col("src").alias("col"), F.col("rate").alias("value"))
    diagonal = edges.groupBy("src").agg((-F.sum("rate")).alias("value")).select(F.col("src").alias("row"), F.col("src").alias("col"), "value")
    return off.unionByName(diagonal)


def submatrix(matrix: DataFrame, members: DataFrame) -> DataFrame:
    """Entries whose row and column are in members (state, grp), renumbered from 0 in each group by state:
    grp, row, col, value."""
    placed = keep(number(members.select("state", "grp"), ["state"], "i", by=["grp"]))
    rows = placed.select(F.col("grp"), F.col("state").alias("row"), F.col("i").alias("ri"))
    cols = placed.select(F.col("grp").alias("g2"), F.col("state").alias("col"), F.col("i").alias("ci"))
    return matrix.join(rows, "row").join(cols, "col").where("grp = g2").select("grp", F.col("ri").alias("row"), F.col("ci").alias("col"), "value")
