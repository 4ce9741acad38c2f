"""Running sums over a whole sorted table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillwater.operators.storage import keep


def _name(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def running(df: DataFrame, order: list[str | Column], sums: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """df and for each (name, column) of `sums` the sum of the column (never negative, no nulls) over all rows before, in
    `order`; with `by`, over those of the row's own group. Rows are range-partitioned, the totals of these ranges, a row
    for each partition, are summed up, and then the rows inside each range. Rows equal in `order` come in any order; so it
    should tell rows apart, or a very frequent value of it is one range."""
    keys = [*map(_name, by or []), *map(_name, order)]
    ranges = keep(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("range_", F.spark_partition_id()))
    totals = ranges.groupBy("range_").agg(*[F.sum(c).alias(f"{n}_total") for n, c in sums.items()])
    whole = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("range_", *[F.coalesce(F.sum(f"{n}_total").over(whole), F.lit(0)).alias(f"{n}_base") for n in sums])
    inside = Window.partitionBy("range_").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = ranges.join(before, "range_").select(*df.columns, *[(F.col(f"{n}_base") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for n, c in sums.items()])
    if not by:
        return out
    out = keep(out)
    first = out.groupBy(*by).agg(*[F.min(n).alias(f"{n}_base") for n in sums]).select(*[F.col(b).alias(f"{b}_group") for b in by], *[f"{n}_base" for n in sums])
    same = [out[b].eqNullSafe(first[f"{b}_group"]) for b in by]
    return out.join(first, same).select(*df.columns, *[(F.col(n) - F.col(f"{n}_base")).alias(n) for n in sums])


def number(df: DataFrame, order: list[str | Column], name: str, by: list[str] | None = None) -> DataFrame:
    """df and each row's place from 0 in `order`, over the whole table or in its group."""
    return running(df.withColumn("one_", F.lit(1).cast("long")), order, {name: "one_"}, by).drop("one_")
