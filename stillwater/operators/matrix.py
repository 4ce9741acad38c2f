"""Sparse matrices as entries (row, col, value), vectors as (idx, value); absent entries are 0."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.operators.storage import keep

#: Rows of the largest block that one task takes: 72 MB.
MOST = 3_000


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(F.col("row").alias("k"), F.col("col").alias("c"), F.col("value").alias("w"))
    return a.join(right, a["col"] == right["k"]).groupBy("row", F.col("c").alias("col")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def matvec(m: DataFrame, x: DataFrame) -> DataFrame:
    v = x.select(F.col("idx").alias("k"), F.col("value").alias("w"))
    return m.join(v, m["col"] == v["k"]).groupBy(F.col("row").alias("idx")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def minor(m: DataFrame, k: int) -> DataFrame:
    """Without row and column k, renumbered."""
    down = lambda c: F.when(F.col(c) > k, F.col(c) - 1).otherwise(F.col(c)).alias(c)
    return m.where((F.col("row") != k) & (F.col("col") != k)).select(down("row"), down("col"), "value")


def hstack(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """b beside a, which has `width` columns."""
    return a.select("row", "col", "value").unionByName(b.select("row", (F.col("col") + width).alias("col"), "value"))


def permuted(m: DataFrame, order: DataFrame) -> DataFrame:
    """Entries named by states -> rows and columns by the places in order(state, ord)."""
    rows, cols = order.select(F.col("state").alias("row"), F.col("ord").alias("r")), order.select(F.col("state").alias("col"), F.col("ord").alias("c"))
    return m.join(rows, "row").join(cols, "col").select(F.col("r").alias("row"), F.col("c").alias("col"), "value")


def sorted_rows(m: DataFrame) -> DataFrame:
    return m.repartitionByRange("row").sortWithinPartitions("row", "col")


def dense(rows, cols, values, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    np.add.at(out, (np.asarray(rows, np.int64), np.asarray(cols, np.int64)), np.asarray(values))
    return out


def determinants(blocks: DataFrame) -> DataFrame:
    """(grp, row, col, value) -> grp, n, sign, log, det of square blocks. log: of the absolute value, which may be beyond what det
    can hold. Blocks of up to MOST rows are each dense in one task. Larger ones are eliminated (elimination.py), for which each
    must be dominated by its diagonal, by rows or by columns, with all other entries of the sign opposite to it, as parts of
    kinetic matrices are; others raise an error."""
    blocks = keep(blocks.select("grp", "row", "col", "value"))
    sizes = keep(blocks.groupBy("grp").agg((F.greatest(F.max("row"), F.max("col")) + 1).cast("long").alias("n")))

    def one(key, pdf):
        import pandas as pd

        n = int(pdf["n"].iloc[0])
        sign, log = np.linalg.slogdet(dense(pdf["row"], pdf["col"], pdf["value"], n))
        return pd.DataFrame({"grp": [key[0]], "n": [n], "sign": [float(sign)], "log": [float(log)]})

    small = blocks.join(sizes.where(F.col("n") <= MOST), "grp").groupBy("grp").applyInPandas(one, "grp bigint, n bigint, sign double, log double")
    large = sizes.where(F.col("n") > MOST)
    if not large.isEmpty():
        small = small.unionByName(_dominated(blocks.join(large, "grp"), large))
    return small.withColumn("det", F.col("sign") * F.exp("log"))


def _dominated(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    from stillwater.operators.elimination import Elimination

    entries = keep(blocks.groupBy("grp", "row", "col").agg(F.sum("value").alias("value")).where("value <> 0"))
    inner = entries.where("row = col").select("grp", F.col("row").alias("state"), "value")
    side = inner.groupBy("grp").agg(F.count("*").alias("filled"), F.min("value").alias("least"), F.max("value").alias("most"))
    side = keep(sizes.join(side, "grp", "left").withColumn("side", F.when(F.col("least") > 0, 1.0).when(F.col("most") < 0, -1.0)))
    off = keep(entries.where("row <> col").join(side.select("grp", "side"), "grp").select("grp", "row", "col", (-F.col("value") * F.col("side")).alias("rate")))
    bad = side.where("side is null or filled < n").select("grp").union(off.where("rate < 0").select("grp"))
    if (found := bad.first()) is not None:
        raise ValueError(f"block {found[0]} is larger than {MOST} rows, and has no diagonal of one sign with all else of the other")

    def lost(by: str) -> DataFrame:
        sums = off.groupBy("grp", F.col(by).alias("state")).agg(F.sum("rate").alias("sum"))
        own = inner.join(side.select("grp", "side"), "grp").select("grp", "state", (F.col("value") * F.col("side")).alias("own"))
        left = own.join(sums, ["grp", "state"], "left").withColumn("rate", F.col("own") - F.coalesce("sum", F.lit(0.0)))
        return keep(left.select("grp", "state", "own", F.when(F.abs("rate") > 1e-12 * F.col("own"), F.col("rate")).otherwise(F.lit(0.0)).alias("rate")))

    rows, cols = lost("row"), lost("col")
    fails = lambda df: df.groupBy("grp").agg(F.min("rate").alias("least"))
    way = keep(fails(rows).withColumnRenamed("least", "r").join(fails(cols).withColumnRenamed("least", "c"), "grp"))
    if (found := way.where("r < 0 and c < 0").first()) is not None:
        raise ValueError(f"block {found[0]} is larger than {MOST} rows, and not dominated by its diagonal")
    by_row = way.select("grp", (F.col("r") >= 0).alias("by_row"))
    links = off.join(by_row, "grp").select(F.col("grp").alias("own"), F.when(F.col("by_row"), F.col("row")).otherwise(F.col("col")).alias("src"), F.when(F.col("by_row"), F.col("col")).otherwise(F.col("row")).alias("dst"), "rate")
    leaks = rows.join(by_row.where("by_row"), "grp").unionByName(cols.join(by_row.where("not by_row"), "grp")).select(F.col("grp").alias("own"), "state", "rate")
    made = Elimination.of(links, leaks, MOST).log_determinants()
    flipped = F.when((F.col("side") < 0) & (F.col("n") % 2 == 1), -1.0).otherwise(1.0)
    return side.join(made.withColumnRenamed("own", "grp"), "grp").select("grp", "n", F.when(F.col("log") == float("-inf"), 0.0).otherwise(flipped).alias("sign"), "log")
