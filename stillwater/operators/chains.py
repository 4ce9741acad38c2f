"""Chains of a graph taken together by pointer doubling, so that loops over it take rounds by the logarithm of a chain's length.

A link is a state with one edge in and one out. Each round lets every link point twice as far ahead and back, in one job, until
its pointers are at states that are no links: its chain's head and tail. Links on a cycle of links alone never get there; they
are told by the round that brings nothing new, and the cycle has the name of its least link by then.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.operators.storage import Rounds, keep, measured


@dataclass
class Chains:
    """members: state, chain (its last link), head, tail (the states before and after it), before, after (steps from the head, to
    the tail), most (the greatest of value + steps among the links from the state on). cycles: state, least. edges: src, dst, length of what is
    left: edges between other states, and an edge for each chain; the longest of each pair. links: how many states go."""

    members: DataFrame
    cycles: DataFrame
    edges: DataFrame
    links: int


def chains(edges: DataFrame, values: DataFrame | None = None) -> Chains:
    """edges: distinct (src, dst) without loops, with a length (1 if there is none); values: (state, value) for `most`, else 0."""
    if "length" not in edges.columns:
        edges = edges.select("src", "dst", F.lit(1).cast("long").alias("length"))
    edges = keep(edges)
    away = edges.groupBy(F.col("src").alias("state")).agg(F.count("*").alias("a"), F.min("dst").alias("next"), F.min("length").alias("ahead")).where("a = 1").drop("a")
    into = edges.groupBy(F.col("dst").alias("state")).agg(F.count("*").alias("b"), F.min("src").alias("last"), F.min("length").alias("back")).where("b = 1").drop("b")
    links = keep(away.join(into, "state"))
    if values is not None:
        links = links.join(values, "state", "left")
    else:
        links = links.withColumn("value", F.lit(0).cast("long"))
    names = links.select("state")
    at = links.join(names.select(F.col("state").alias("next"), F.lit(True).alias("on")), "next", "left").join(names.select(F.col("state").alias("last"), F.lit(True).alias("off")), "last", "left")
    start = at.select("state", "next", "ahead", "last", "back", F.coalesce("on", F.lit(False)).alias("on"), F.coalesce("off", F.lit(False)).alias("off"), F.col("state").alias("least"), F.col("state").alias("chain"), F.coalesce("value", F.lit(0)).cast("long").alias("most"))
    metrics = F.count(F.lit(1)).alias("n"), F.count_if(F.col("on") | F.col("off")).alias("open"), F.bit_xor(F.xxhash64("state", "least")).alias("names")
    now, seen = measured(start, *metrics)
    total = seen["n"]
    rounds = Rounds("pointer doubling")
    while seen["open"]:
        rounds.next()
        ahead = now.select(F.col("state").alias("to_"), F.col("next").alias("n2"), F.col("ahead").alias("a2"), F.col("on").alias("on2"), F.col("least").alias("l2"), F.col("chain").alias("c2"), F.col("most").alias("m2"))
        back = now.select(F.col("state").alias("from_"), F.col("last").alias("p2"), F.col("back").alias("b2"), F.col("off").alias("off2"))
        met = now.join(ahead, F.col("on") & (F.col("next") == F.col("to_")), "left").join(back, F.col("off") & (F.col("last") == F.col("from_")), "left")
        further = met.select(
            "state", F.coalesce("n2", "next").alias("next"), (F.col("ahead") + F.coalesce("a2", F.lit(0))).alias("ahead"), F.coalesce("p2", "last").alias("last"), (F.col("back") + F.coalesce("b2", F.lit(0))).alias("back"),
            F.coalesce("on2", F.lit(False)).alias("on"), F.coalesce("off2", F.lit(False)).alias("off"), F.least("least", F.coalesce("l2", "least")).alias("least"), F.coalesce("c2", "chain").alias("chain"), F.greatest("most", F.coalesce(F.col("ahead") + F.col("m2"), F.col("most"))).alias("most"),
        )
        before = seen
        now, seen = measured(further, *metrics)
        if seen == before:
            break
    members = now.where("not on and not off").select("state", "chain", F.col("last").alias("head"), F.col("next").alias("tail"), F.col("back").alias("before"), F.col("ahead").alias("after"), "most")
    cycles = now.where("on or off").select("state", "least")
    rest = edges.join(names.withColumnRenamed("state", "src"), "src", "left_anti").join(names.withColumnRenamed("state", "dst"), "dst", "left_anti")
    whole = members.where("state = chain").select(F.col("head").alias("src"), F.col("tail").alias("dst"), (F.col("before") + F.col("after")).alias("length"))
    left = keep(rest.select("src", "dst", "length").unionByName(whole).groupBy("src", "dst").agg(F.max("length").alias("length")))
    return Chains(members, cycles, left, total)
