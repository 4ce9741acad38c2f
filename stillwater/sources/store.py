"""Stored results: a folder for each model, zero pattern and set of rates, with a Parquet table for each relation.

    <root>/<model key>/<zero pattern>/graph/<part>/{edges,states}     what only the pattern of zero rates decides: a part for
                                                                      each time that starts led to states not stored before
    <root>/<model key>/<zero pattern>/<rates>/<parts>/{stationary,absorption}

A manifest, written last, lists the rows of each table; a folder without one, or with other counts, is incomplete.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from stillwater.operators.rates import Rates, zero_pattern
from stillwater.sources.models import BooleanModel


class IncompleteStore(RuntimeError):
    """Stored tables that are not what their manifest says."""


def graph_folder(root: str, model: BooleanModel, rates: Rates) -> str:
    pattern = hashlib.sha256(zero_pattern(rates).encode()).hexdigest()[:12]
    return f"{root.rstrip('/')}/{model.key}/{pattern}/graph"


def numbers_folder(root: str, model: BooleanModel, rates: Rates, parts: int) -> str:
    """parts: those of the graph that the numbers are for."""
    digest = hashlib.sha256(json.dumps(rates).encode()).hexdigest()[:16]
    return f"{graph_folder(root, model, rates).removesuffix('/graph')}/{digest}/{parts}"


def load_parts(spark: SparkSession, folder: str) -> list[dict[str, DataFrame]]:
    """The tables of a folder's parts 0, 1, ..."""
    out: list[dict[str, DataFrame]] = []
    while (found := load(spark, f"{folder}/{len(out)}")) is not None:
        out.append(found)
    return out


def save(folder: str, tables: dict[str, DataFrame]) -> None:
    counts = {}
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        counts[name] = spark.read.parquet(f"{folder}/{name}").count()
    spark.createDataFrame([(json.dumps(counts),)], "manifest string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame] | None:
    """The tables of a folder, or None if nothing is stored there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    counts = json.loads(spark.read.parquet(f"{folder}/manifest").first()[0])
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in counts}
    for name, df in tables.items():
        if (found := df.count()) != counts[name]:
            raise IncompleteStore(f"{folder}/{name} has {found} rows, not {counts[name]}")
    return tables


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two relations have the same rows, as often."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
