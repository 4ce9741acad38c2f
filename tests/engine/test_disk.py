"""What loops leave on disk."""

import time

import pytest
from pyspark.sql import functions as F

from stillwater.operators import graph, storage


def _shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


@pytest.mark.parametrize("store", [storage.keep, storage.Pile, lambda df: storage.Shelves(df, "k"), lambda df: storage.divided(df, F.col("n") > 10)], ids=["keep", "pile", "shelves", "divided"])
def test_shuffles_go_with_the_write(spark, store):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, conf = _shuffles(spark), spark.conf.get(name)
    store(spark.range(10000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    assert spark.conf.get(name) == conf
    for _ in range(50):
        left = _shuffles(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left


def test_edges_of_which_none_goes_are_stored_once(spark, monkeypatch):
    rows = []
    kept = storage.keep
    monkeypatch.setattr(storage, "keep", lambda df, *a: rows.append((out := kept(df, *a)).count()) or out)
    live, n = graph.trim(spark.createDataFrame([(i, (i + 1) % 30) for i in range(30)], "src bigint, dst bigint"))
    assert n == 30 and live.count() == 30 and rows.count(30) == 1
    live, n = graph.trim(spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 3), (9, 0)], "src bigint, dst bigint"))
    assert n == 2 and {tuple(r) for r in live.collect()} == {(0, 1), (1, 0)}
    live, n = graph.trim(spark.createDataFrame([], "src bigint, dst bigint"))
    assert n == 0 and live.count() == 0
