"""No table that grows with the documents may be broadcast: small ones show by plan what would be."""

import re

import pytest

import corpus_pipeline
from stillwater.llm import common, minhash, mixing
from stillwater.operators import storage

DOCUMENTS = [(i, " ".join(f"w{(i // 3 * 7 + j * j) % 97}" for j in range(30)) + " end" * (i % 3), f"s{i % 2}") for i in range(60)]


@pytest.fixture
def sides(monkeypatch):
    """What the plans of all stored tables broadcast: the columns of each broadcast side."""
    seen = []
    kept = storage.keep

    def keep(df, *args, **options):
        seen.append(df)
        return kept(df, *args, **options)

    monkeypatch.setattr(storage, "keep", keep)
    monkeypatch.setattr(common, "keep", keep)

    def of(*more):
        found = []
        for df in [*seen, *more]:
            plan = df._jdf.queryExecution().executedPlan().toString()
            found += re.findall(r"BroadcastExchange[^\n]*\n[^\n]*?((?:Project|HashAggregate|Filter|FileScan|Generate|Scan|Exchange)[^\n]*)", plan)
        return found

    return of


@pytest.mark.parametrize("few", [16, 0])
def test_near_duplicates_broadcast_only_bits_and_counts(spark, sides, few):
    documents = common.stash(spark.createDataFrame([r[:2] for r in DOCUMENTS], "doc_id bigint, text string"), "test-documents")
    made = common.stash(minhash.near_duplicates(documents, width=2, few=few), "test-near")
    assert made.count() == len(DOCUMENTS)
    for side in sides():
        assert "bits_" in side or "1024.0" in side or "256.0" in side, side


def test_pipeline_stage_broadcasts_only_bits_and_counts(spark, sides):
    documents = common.stash(spark.createDataFrame(DOCUMENTS, "doc_id bigint, text string, source string"), "test-documents")
    kept = common.stash(corpus_pipeline.drop_near_copies(spark, documents, ""), "test-kept")
    assert 0 < kept.count() < len(DOCUMENTS)
    for side in sides():
        assert "bits_" in side or "1024.0" in side or "256.0" in side, side


def test_mixing_sizes_its_targets_after_the_explode(spark, sides):
    documents = common.stash(spark.createDataFrame(DOCUMENTS, "doc_id bigint, text string, source string"), "test-documents")
    out = mixing.mix(documents)
    assert out.count()
    for side in sides(out):
        assert "held_" not in side and "position_" not in side, side
        if "their" in side:
            assert side.startswith("Exchange hashpartitioning(their"), side
