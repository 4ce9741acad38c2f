"""Every registered query of this subpackage, run once over small tables with nulls and repeated rows."""

import hashlib

import pytest

from stillwater.llm import queries

DOCUMENTS = [(1, "a b c a b c d e f", "s1"), (1, "a b c a b c d e f", "s1"), (2, None, "s2"), (3, "", None), (None, "null id text mail me@x.org", "s1"), (None, None, None), (4, "A B C a b c d e f", "s2"), (5, "é 127.0.0.1 " * 40, "s1")]
DOCUMENT_QUERIES = ["op1_bpe", "op2_pii", "op4_media", "op5_toxicity", "op7_minhash", "op8_lm", "op9_mixing", "op11_suffixes", "op12_alignment"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    made = {
        "documents": ([(i, t, "en", s, len(t or "")) for i, t, s in DOCUMENTS], "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        "labels": ([(1, 1, 1), (2, None, None), (4, 0, 0), (5, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int"),
        "pages": ([(1, "u", "x" * 1200), (2, None, "x" * 1200), (2, None, "x" * 1200), (None, "n", None)], "page_id bigint, url string, html string"),
        "conversations": ([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", None), (3, None, "user", None), (None, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string"),
        "embeddings": ([(i, [1.0, float(i)], 0) for i in range(30)] + [(20, [1.0, 20.0], 0), (40, None, 1), (60, [0.0, 0.0], 1), (None, [1.0, 1.0], 1)], "vec_id bigint, embedding array<float>, label int"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{where}/{name}.parquet")
    return where


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_document_queries(spark, tables, name):
    got = queries.QUERIES[name](spark, tables).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, *_ in DOCUMENTS)
    if name == "op4_media":  # n_bytes and payload of every text
        for r in got:
            texts = [(t or "").encode() for i, t, _ in DOCUMENTS if i == r["doc_id"]]
            padded = [(t + bytes(-len(t) % 64 if t else 64)) for t in texts]
            assert r["n_bytes"] in map(len, texts) and r["payload_sha256"] in [hashlib.sha256(p).hexdigest() for p in padded]
        assert len({r["feature"] for r in got if r["doc_id"] == 1}) == 1
    if name == "op2_pii":
        assert sum(r["n_ip"] for r in got) == 40 and sum(r["n_email"] for r in got) == 1
    if name == "op7_minhash":
        assert {r["component_id"] for r in got if r["doc_id"] in (1, 4)} == {1}


def test_other_queries(spark, tables):
    records = queries.QUERIES["op6_warc"](spark, tables).collect()
    assert sorted((str(r["page_id"]), r["record_type"]) for r in records) == [("1", "revisit"), ("2", "response"), ("2", "revisit"), ("None", "response")]
    pairs = queries.QUERIES["op3_chat"](spark, tables).collect()
    assert sorted((r["kind"], r["chosen_id"], r["rejected_id"]) for r in pairs) == [("answer", 1, 1), ("opening", 1, 2)]
    near = queries.QUERIES["op10_ann"](spark, tables).collect()
    assert {r["query_id"] for r in near} == {0, 20}
    assert [r["vec_id"] for r in sorted((r for r in near if r["query_id"] == 0), key=lambda r: r["rank"])] == list(range(1, 21))  # ties by id
    assert sorted(r["vec_id"] for r in near if r["query_id"] == 20) == sorted([x for x in range(29, 8, -1) if x != 20] * 2)
    hard = {(r["anchor_id"], r["positive_id"], r["negative_id"], r["rank"]) for r in queries.QUERIES["op13_negatives"](spark, tables).collect()}
    assert hard == {(0, p, n, n) for p in (7, 14, 21, 28) for n in range(1, 6)}  # all scores are equal; row 60's is 0, which no other has
