"""Transition rates: an up and a down rate for each node."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from stillwater.sources.models import BooleanModel

Rates = tuple[tuple[float, float], ...]


def _checked(model: BooleanModel, overrides: dict[str, float] | list[tuple[str, float]] | None) -> dict[int, float]:
    out = {}
    for node, rate in (overrides.items() if isinstance(overrides, dict) else overrides or ()):
        if node not in model.place:
            raise ValueError(f"{node} is no node")
        if not math.isfinite(rate) or rate < 0:
            raise ValueError(f"the rate of {node} is not a number from 0")
        out[model.place[node]] = float(rate)
    return out


def _assembled(model: BooleanModel, up, down, draw) -> Rates:
    up, down = _checked(model, up), _checked(model, down)
    return tuple((up[i] if i in up else draw(), down[i] if i in down else draw()) for i in range(len(model.nodes)))


def uniform(model: BooleanModel, up=None, down=None) -> Rates:
    """1 for all that is not given. up, down: dicts, or lists of pairs of which the last one of a node counts."""
    return _assembled(model, up, down, lambda: 1.0)


def normal(model: BooleanModel, mean: float = 0.0, std: float = 1.0, up=None, down=None, seed: int = 5489, tries: int = 1000) -> Rates:
    """Draws from a normal distribution, again while negative; the same for the same seed."""
    random = np.random.default_rng(seed)

    def draw() -> float:
        for _ in range(tries):
            if (x := float(random.normal(mean, std))) >= 0:
                return x
        raise ValueError(f"no rate from 0 in {tries} draws")

    return _assembled(model, up, down, draw)


def parse_overrides(text: str) -> tuple[list[tuple[str, float]], list[tuple[str, float]]]:
    """"u_A=2,d_B=0.5" -> the up and the down rates."""
    out = [], []
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(r"([udUD])_(\w+)=(\S+)", part)
        if not m:
            raise ValueError(f"not a rate: {part}")
        out[m[1].lower() == "d"].append((m[2], float(m[3])))
    return out


def rate_table(spark: SparkSession, model: BooleanModel, rates: Rates) -> DataFrame:
    rows = [(i, n, u, d) for i, (n, (u, d)) in enumerate(zip(model.nodes, rates, strict=True))]
    return spark.createDataFrame(rows, "var int, node string, up_rate double, down_rate double")


def zero_pattern(rates: Rates) -> str:
    """Which rates are zero: what decides the graph."""
    return "".join(f"{int(u == 0)}{int(d == 0)}" for u, d in rates)


def compatible(a: Rates, b: Rates) -> bool:
    """Whether results for one can reuse the graph of the other."""
    if len(a) != len(b):
        raise ValueError("the rates are of models of different sizes")
    return zero_pattern(a) == zero_pattern(b)
