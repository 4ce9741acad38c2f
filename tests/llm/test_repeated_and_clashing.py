"""Inputs that once went wrong: openings that run together, frequent openings, repeated rows, columns with results' names."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from stillwater.llm import chat, minhash


def test_openings_that_run_together_are_two(spark):
    turns = [(1, 0, "a\nb", "c"), (2, 0, "a", "b\nc"), (3, 0, "a", "b\nc")]
    chats = chat.conversations(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))
    assert [(r["chosen_id"], r["rejected_id"]) for r in chat.pairs_by_opening(chats).collect()] == [(2, 3)]


def test_frequent_openings_are_salted(spark, monkeypatch):
    monkeypatch.setattr(chat, "SALT_ROWS", 4)
    turns = [(i, 0, "user", "hi" if i < 30 else f"hi {i // 2}") for i in range(40)]
    chats = chat.conversations(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))
    got = sorted((r["chosen_id"], r["rejected_id"]) for r in chat.pairs_by_opening(chats).collect())
    assert got == [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(30, 40, 2)]


def test_near_copies_in_many_rows(spark, monkeypatch):
    """Rows of one id are one document: its set is made once, and pairs of sets do not grow with the rows."""
    rng = random.Random(1)
    one = [f"w{rng.randrange(999)}" for _ in range(400)]
    two = [*one[:390], *(f"v{i}" for i in range(10))]
    rows = [(1, " ".join(one))] * 60 + [(2, " ".join(two))] * 60 + [(3, "something else entirely")]
    seen = []
    kept = minhash.full_sets

    def counted(documents, width):
        made = kept(documents, width)
        seen.append(made.dropDuplicates(["doc_id", "set_key"]).count())
        return made

    monkeypatch.setattr(minhash, "full_sets", counted)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 121 and {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(1, 1, True), (2, 1, False), (3, 3, True)}
    assert seen == [2]


def test_pipeline_stages_with_names_of_results(spark, tmp_path):
    labels = [(i, 0, int(i % 2)) for i in range(40)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(i, ("awful vile insult " if i % 2 else "calm clear note ") * 5 + f"mail me{i}@x.org today", "en", "s", 0, 0.25, "kept", -1, "row") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, spans string, n bigint, passages string")
    clean = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == set(range(0, 40, 2))
    masked = corpus_pipeline.mask_personal_data(spark, clean, str(tmp_path))
    assert masked.columns == docs.columns and masked.schema == docs.schema
    for r in masked.collect():
        assert r["text"].endswith("mail [EMAIL] today") and r["n_chars"] == len(r["text"]) and (r["score"], r["spans"], r["n"], r["passages"]) == (0.25, "kept", -1, "row")
    assert corpus_pipeline.mask_personal_data(spark, docs.drop("n_chars"), str(tmp_path)).where(F.col("text").contains("@")).isEmpty()
    near = corpus_pipeline.drop_near_copies(spark, docs.withColumn("component_id", F.lit(9)), str(tmp_path))
    assert near.where("component_id = 9").count() == near.count() > 0
