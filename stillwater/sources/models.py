"""Boolean network models: text files, single or many, and the relations that describe them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stillwater.functions import boolean


@dataclass(frozen=True)
class BooleanModel:
    """Nodes in order, and a rule for each."""

    nodes: tuple[str, ...]
    rules: tuple[boolean.Rule, ...]

    def __post_init__(self):
        if len(set(self.nodes)) < len(self.nodes):
            raise ValueError("a node is defined twice")
        unknown = {x for r in self.rules for x in boolean.names(r)} - set(self.nodes)
        if unknown:
            raise ValueError(f"rules use names that are no nodes: {', '.join(sorted(unknown))}")

    @cached_property
    def place(self) -> dict[str, int]:
        return {n: i for i, n in enumerate(self.nodes)}

    @property
    def inputs(self) -> list[int]:
        """Nodes whose rule is the node itself: their bits never change."""
        return [i for i, (n, r) in enumerate(zip(self.nodes, self.rules, strict=True)) if r == boolean.Name(n)]

    @cached_property
    def key(self) -> str:
        """A digest of nodes and rules, whatever the spacing of the text they came from."""
        text = "\n".join(f"{n},{boolean.text_of(r)}" for n, r in zip(self.nodes, self.rules, strict=True))
        return hashlib.sha256(text.encode()).hexdigest()[:24]

    def clause_masks(self, node: str, negated: bool = False, limit: int | None = None) -> list[tuple[int, int]]:
        """(positive mask, negative mask) of each clause of a node's rule, or of its negation."""
        found = boolean.clauses(self.rules[self.place[node]], negated, limit)
        return sorted((sum(1 << self.place[n] for n, s in c if s), sum(1 << self.place[n] for n, s in c if not s)) for c in found)


def parse_model(text: str) -> BooleanModel:
    """Lines "node, rule"; a first line that begins with "targets" is a header; empty lines are left out."""
    nodes, rules = [], []
    for number, line in enumerate(text.splitlines()):
        if not line.strip() or number == 0 and line.startswith("targets"):
            continue
        node, comma, rule = line.partition(",")
        if not comma:
            raise ValueError(f"line {number + 1} has no comma")
        nodes.append(node.strip())
        rules.append(boolean.parse(rule))
    return BooleanModel(tuple(nodes), tuple(rules))


def read_model(path: str, spark: SparkSession | None = None) -> BooleanModel:
    """From the driver's disk, or with a session from any path that Spark reads."""
    if spark is None:
        return parse_model(Path(path).read_text())
    return parse_model(spark.read.text(path, wholetext=True).first()[0])


def read_corpus(spark: SparkSession, pattern: str) -> DataFrame:
    """model_id (file name without ending), idx, node, factor of all files that match; a file is one row while read."""
    files = spark.read.text(pattern, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("model_id"), "value")
    lines = files.select("model_id", F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    lines = lines.where((F.trim("text") != "") & ~((F.col("line") == 0) & F.col("text").startswith("targets")))
    parts = F.split("text", ",", 2)
    order = Window.partitionBy("model_id").orderBy("line")
    return lines.select("model_id", (F.row_number().over(order) - 1).cast("int").alias("idx"), F.trim(parts[0]).alias("node"), F.regexp_replace(parts[1], r"^\s+|\s+$", "").alias("factor"))


def model_of(rows: DataFrame, model_id: str) -> BooleanModel:
    """A model from read_corpus() rows."""
    found = rows.where(F.col("model_id") == model_id).orderBy("idx").collect()
    return parse_model("\n".join(f"{r['node']},{r['factor']}" for r in found))


def models_of(rows: DataFrame) -> Iterator[tuple[str, BooleanModel]]:
    """All models of read_corpus() rows by id, one at a time."""
    for (model_id,) in rows.select("model_id").distinct().orderBy("model_id").toLocalIterator():
        yield model_id, model_of(rows, model_id)


def clause_texts(spark: SparkSession, model: BooleanModel) -> DataFrame:
    """node, clause: the clauses of each rule as text."""
    rows = [(n, boolean.clause_text(c, model.nodes)) for n, r in zip(model.nodes, model.rules, strict=True) for c in boolean.clauses(r)]
    return spark.createDataFrame(rows, "node string, clause string")


def clause_table(spark: SparkSession, model: BooleanModel) -> DataFrame:
    """node_idx, clause_idx, p_mask, n_mask."""
    rows = [(i, k, p, n) for i, node in enumerate(model.nodes) for k, (p, n) in enumerate(model.clause_masks(node))]
    return spark.createDataFrame(rows, "node_idx int, clause_idx int, p_mask bigint, n_mask bigint")
