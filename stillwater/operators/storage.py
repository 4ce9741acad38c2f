"""Cutting lineage in loops: tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def folder(spark: SparkSession, label: str = "rounds") -> str:
    """A new folder under spark.checkpoint.dir, the scratch space of a session: nothing in it is needed after its end. Only a local session may go without that setting, and uses a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stillwater-"))
        where = spark.sparkContext.getCheckpointDir()
    return f"{where.rstrip('/')}/{label}/{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Inside it, the shuffle files of a write go as soon as it ends. Nothing reads them again, as its rows are in the table, and else they
    stay until the driver happens to collect its garbage: in a loop, those of many rounds."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def keep(df: DataFrame, codec: str = "zstd", label: str = "rounds", most: int = 0) -> DataFrame:
    """df computed once and read from a table from now on, so that it outlives any executor and its size is known. most: rows of a
    file, for large rows, as a file's rows are held together when they are written and read; 0: any number."""
    path = folder(df.sparkSession, label)
    with tidy(df.sparkSession):
        df.write.option("compression", codec).option("maxRecordsPerFile", most).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, *metrics: Column) -> tuple[DataFrame, dict]:
    """keep(), and metrics (aggregates, by their names) of its rows, by default their number n, taken in the same job."""
    seen = Observation()
    kept = keep(df.observe(seen, *(metrics or (F.count(F.lit(1)).alias("n"),))))
    return kept, seen.get


def divided(df: DataFrame, condition: Column) -> tuple[DataFrame | None, DataFrame | None, dict]:
    """keep() of the rows that meet a condition and of the others, in one job; None for a side without rows. Counts: yes, no."""
    seen, path = Observation(), folder(df.sparkSession)
    marked = df.withColumn("side_", condition).observe(seen, F.count_if("side_").alias("yes"), F.count_if(~F.col("side_")).alias("no"))
    with tidy(df.sparkSession):
        marked.write.partitionBy("side_").parquet(path)
    counts = seen.get
    sides = [df.sparkSession.read.schema(df.schema).parquet(f"{path}/side_={v}") if counts[n] else None for n, v in (("yes", "true"), ("no", "false"))]
    return sides[0], sides[1], counts


class Pile:
    """A table that grows round by round, without writing anew what it has. added: the rows of the last part."""

    def __init__(self, first: DataFrame):
        self.spark, self.schema, self.paths, self.added = first.sparkSession, first.schema, [], 0
        self.add(first)

    def add(self, df: DataFrame) -> DataFrame:
        seen = Observation()
        self.paths.append(folder(self.spark))
        with tidy(self.spark):
            df.select(*self.schema.names).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(self.paths[-1])
        self.added = seen.get["n"]
        return self.spark.read.schema(self.schema).parquet(self.paths[-1])

    @property
    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)

    @staticmethod
    def of(parts: list[DataFrame], none: DataFrame) -> DataFrame:
        """Kept tables of one schema as one; `none` if there are none."""
        if not parts:
            return none
        files = sorted({f.rsplit("/", 1)[0] for p in parts for f in p.inputFiles()})
        return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*files)


class Shelves:
    """A table with a folder for each value of a column of few values, which grows, and of which one value's rows are read alone."""

    def __init__(self, first: DataFrame, by: str):
        self.spark, self.schema, self.by = first.sparkSession, first.schema, by
        self.rest = StructType([f for f in first.schema if f.name != by])
        self.places: dict[int, list[str]] = {}
        self.add(first)

    def add(self, df: DataFrame) -> None:
        seen, path = Observation(), folder(self.spark)
        with tidy(self.spark):
            df.select(*self.schema.names).observe(seen, F.collect_set(self.by).alias("values")).write.partitionBy(self.by).parquet(path)
        for v in seen.get["values"]:
            self.places.setdefault(v, []).append(f"{path}/{self.by}={v}")

    def of(self, value: int) -> DataFrame:
        reader = self.spark.read.schema(self.rest)
        found = reader.parquet(*self.places[value]) if value in self.places else self.spark.createDataFrame([], self.rest)
        return found.withColumn(self.by, F.lit(value).cast(self.schema[self.by].dataType)).select(*self.schema.names)


class Rounds:
    """Counts the rounds of a loop that is known to end, and fails if it does not."""

    def __init__(self, what: str, most: int = 1_000_000):
        self.what, self.left = what, most

    def next(self) -> None:
        self.left -= 1
        if self.left < 0:
            raise RuntimeError(f"{self.what} does not end")
