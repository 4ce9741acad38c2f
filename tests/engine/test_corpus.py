"""A corpus of models solved in one plan gives what each model's own solver gives, and takes no more jobs for more models."""

from __future__ import annotations

from pyspark.sql import functions as F

from stillwater.operators import rates, states
from stillwater.plans import workloads as w
from stillwater.plans.corpus import CorpusSolver, rows_of
from stillwater.plans.solver import Solver
from stillwater.sources.models import parse_model, read_corpus

CORPUS = "model_id string, idx int, node string, factor string"
FLIP = parse_model("A, !B\nB, A\nC, A & C | B")


def test_a_folder_of_models(spark, tmp_path):
    (tmp_path / "pair.bnet").write_text("targets, factors\nA, B\nB, !A\n")
    (tmp_path / "toy.bnet").write_text("A, A\nC, !A & !D\nD, !A & !C\n")
    start = spark.createDataFrame([("pair", 0, 1.0), ("toy", 0, 1.0)], "model_id string, state bigint, p double")
    s = CorpusSolver(read_corpus(spark, f"{tmp_path}/*.bnet"), start)
    got = {(r["model_id"], r["nodes"]): r["p"] for r in s.final.collect()}
    want = {("pair", "<nil>"): 0.25, ("pair", "A"): 0.25, ("pair", "B"): 0.25, ("pair", "A --- B"): 0.25, ("toy", "C"): 0.5, ("toy", "D"): 0.5}
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_models_with_rates(spark):
    models = {"flip": FLIP, "latch": w.LATCH, "toy": w.TOY}
    own = {"flip": rates.uniform(FLIP, up={"A": 3.0}, down={"B": 0.5}), "toy": rates.uniform(w.TOY, down={"C": 0.0})}
    corpus = spark.createDataFrame(list(rows_of(models)), CORPUS)
    start = spark.range(8).select(F.explode(F.array(*map(F.lit, models))).alias("model_id"), F.col("id").alias("state"), F.lit(0.125).alias("p"))
    given = spark.createDataFrame([(m, n, *map(float, own[m][i])) for m in own for i, n in enumerate(models[m].nodes)], "model_id string, node string, up double, down double")
    got = {(r["model_id"], r["state"]): r["p"] for r in CorpusSolver(corpus, start, given).final.collect()}
    want = {(m, r["state"]): r["p"] for m in models for r in Solver(spark, models[m], own.get(m), states.uniform(spark, models[m])).final.collect()}
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 1e-12


def test_jobs_do_not_grow_with_models(spark):
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for n in (2, 12):
        corpus = spark.createDataFrame([r for i in range(n) for r in rows_of({f"m{i}": w.RING})], CORPUS)
        start = spark.createDataFrame([(f"m{i}", 0, 1.0) for i in range(n)], "model_id string, state bigint, p double")
        spark.sparkContext.setJobGroup(f"corpus{n}", "corpus")
        final = CorpusSolver(corpus, start).final
        assert final.count() == 6 * n and abs(final.agg(F.sum("p")).first()[0] - n) < 1e-9
        jobs.append(len(tracker.getJobIdsForGroup(f"corpus{n}")))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs[1] <= jobs[0] + 5, jobs
