"""State spaces and distributions over them: (state, p), an absent state has probability 0."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwater.functions import bits
from stillwater.sources.models import BooleanModel


def space(spark: SparkSession, n: int) -> DataFrame:
    """All states of n nodes."""
    if n > bits.MOST_NODES:
        raise ValueError(f"{n} nodes have too many states to list; solve from a bounded set of initial states instead")
    return spark.range(1 << n).withColumnRenamed("id", "state")


def subcube(spark: SparkSession, n: int, fixed: dict[int, int]) -> DataFrame:
    """The states in which the bits of `fixed` have its values: only these are generated."""
    free = [i for i in range(n) if i not in fixed]
    return space(spark, len(free)).select(bits.deposit(F.col("state"), free, sum(1 << i for i, v in fixed.items() if v)).alias("state"))


def checked_fixed(model: BooleanModel, fixed: dict[str, int] | list[tuple[str, int]]) -> dict[int, int]:
    pairs = list(fixed.items()) if isinstance(fixed, dict) else list(fixed)
    for node, value in pairs:
        if node not in model.place:
            raise ValueError(f"{node} is no node")
        if value not in (0, 1):
            raise ValueError(f"{node} can be 0 or 1")
    out = {model.place[n]: int(v) for n, v in pairs}
    if len(out) < len(pairs):
        raise ValueError("a node is fixed twice")
    return out


def uniform(spark: SparkSession, model: BooleanModel) -> DataFrame:
    n = len(model.nodes)
    return space(spark, n).select("state", F.lit(1.0 / (1 << n)).alias("p"))


def fixed(spark: SparkSession, model: BooleanModel, values: dict[str, int] | list[tuple[str, int]], probability: float = 1.0) -> DataFrame:
    """The states with these values share `probability`, all others the rest."""
    if not 0 <= probability <= 1:
        raise ValueError("the probability is not between 0 and 1")
    n, where = len(model.nodes), checked_fixed(model, values)
    if not where:
        return uniform(spark, model)
    inside = 1 << (n - len(where))
    if probability == 1:
        return subcube(spark, n, where).select("state", F.lit(1.0 / inside).alias("p"))
    care, value = sum(1 << i for i in where), sum(1 << i for i, v in where.items() if v)
    is_in = F.col("state").bitwiseAND(F.lit(care)) == F.lit(value)
    p = F.when(is_in, F.lit(probability / inside)).otherwise(F.lit((1 - probability) / ((1 << n) - inside)))
    return space(spark, n).select("state", p.alias("p")).where("p > 0")


def empirical(rows: DataFrame, state: str = "state") -> DataFrame:
    """The share of the rows in each state. The total is one row; it joins as a scalar."""
    counts = rows.groupBy(state).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("total"))
    return counts.join(F.broadcast(total)).select(F.col(state).alias("state"), (F.col("c") / F.col("total")).alias("p"))


def parse_fixed(text: str) -> list[tuple[str, int]]:
    """"A=1,B=0" -> pairs."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(r"(\w+)=([01])", part)
        if not m:
            raise ValueError(f"not a fixed node: {part}")
        out.append((m[1], int(m[2])))
    return out
