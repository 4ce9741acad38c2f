"""Encoding, personal data, toxicity, language model: against public libraries, brute force and held-out rows."""

import base64
import hashlib
import itertools
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwater.llm import bpe, common, lm, pii, toxicity

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "A", "a" * 5000, "don't \n\n  stop", "<|endoftext|>", "éè \U0001f600‍", "x y " * 3000, "0123 4567\t8", "ABAB" * 400]


def rows(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)], "doc_id bigint, text string, n_tokens string, score int")


def test_encoding_equals_the_public_library(spark):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(3)
    texts = ODD + ["".join(draw.choice("abcdeABC  \n.,'1é中\U0001f600") for _ in range(draw.randint(1, 200))) for _ in range(150)] + [ODD[5]]
    got = bpe.encode_documents(rows(spark, texts), path, P.PATTERN, keep_ids=True, chunk_bytes=20_000, most_words=50).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(rows(spark, texts).limit(0), path, P.PATTERN).count() == 0


def base_by_patterns(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_patterns():
    draw = random.Random(1)
    for _ in range(20_000):
        t = "".join(draw.choice("0123456789..--  +()@@ab%é_") for _ in range(draw.randint(0, 60)))
        assert base_by_patterns(t) == pii.base_spans(t)


def test_field_on_held_out_sentences():
    field, right, wrong, all_ = pii.trained(), 0, 0, 0
    for text, spans in pii.examples(200, seed=77):
        got = {x for a, b in pii.regions(text) for x in field.decode(text, a, b)}
        right, wrong, all_ = right + len(got & set(spans)), wrong + len(got - set(spans)), all_ + len(spans)
    assert right >= 0.95 * all_ and wrong <= 0.05 * all_


def test_decoding_and_expectations_against_enumeration():
    field = pii.trained()
    text = "call (310) 555-4510 now"
    start, end = next(pii.regions(text))
    bounds, segments = pii.candidates(text, start, end)
    n, scores = len(bounds) - 1, field.scores(segments)

    def walks(at):
        if at == n:
            yield ()
            return
        for rest in walks(at + 1):
            yield rest
        for s, (i, j, _) in enumerate(segments):
            if i == at:
                for k, rest in itertools.product(range(len(pii.KINDS)), walks(j)):
                    yield ((k, s), *rest)

    def value(walk):
        return sum(scores[k, s] for k, s in walk) + field.outside * (n - sum(segments[s][1] - segments[s][0] for _, s in walk))

    found = [(value(x), x) for x in walks(0)]
    best = max(found)[1]
    assert field.decode(text, start, end) == [(pii.KINDS[k], bounds[segments[s][0]], bounds[segments[s][1]]) for k, s in best]
    p, _ = field.expectations(n, segments, scores)
    total = np.logaddexp.reduce([v for v, _ in found])
    k, s = best[0]
    assert abs(p[k, s] - sum(math.exp(v - total) for v, x in found if (k, s) in x)) < 1e-9


def test_long_regions_take_little_memory():
    text = "1 " * 30_000
    field, ((start, end),) = pii.trained(), pii.regions(text)
    field.decode(text, start, start + 100)
    tracemalloc.start()
    field.decode(text, start, end)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(text)


def test_personal_data_rows(spark):
    texts = [None, "", "a@b.co and (310) 555-4510", "7536784127813050 4845168114407329", "1 " * 4000]
    got = {r["doc_id"]: r for r in pii.find(rows(spark, texts)).collect()}
    assert got[0]["masked"] is None and got[1]["spans"] == ""
    assert got[2]["spans"] == "email:0:6,phone:11:25" and got[2]["n_phone"] == 0 and got[2]["masked"] == "[EMAIL] and [PHONE]"
    assert got[4]["n_card"] == 0
    assert {(r["doc_id"], r["n_tokens"], r["score"]) for r in pii.find(rows(spark, texts[2:3] * 3, [None, 7, 7])).collect()} == {(None, "x", 1), (7, "x", 1)}
    assert pii.find(rows(spark, texts).limit(0)).count() == 0


def brute_segments(scores):
    """The intervals of which every proper part scores less, and that lie in no other such interval."""
    n = len(scores)
    total = np.append(0.0, np.cumsum(scores))
    every = [(i, j) for i in range(n) for j in range(i + 1, n + 1)]
    dense = [(i, j) for i, j in every if total[j] - total[i] > 0 and all(total[b] - total[a] < total[j] - total[i] for a in range(i, j) for b in range(a + 1, j + 1) if (a, b) != (i, j))]
    return [(i, j, total[j] - total[i]) for i, j in dense if not any(a <= i and j <= b and (a, b) != (i, j) for a, b in dense)]


def test_segments_against_all_intervals():
    draw = np.random.default_rng(2)
    for _ in range(600):
        x = draw.integers(-3, 4, draw.integers(1, 14)).astype(float)
        assert toxicity.maximal_segments(x) == brute_segments(x)
    assert toxicity.maximal_segments(np.zeros(0)) == []


@pytest.mark.parametrize("pattern", [[1.0, -2.0], [2.0, -1.0], [1.0, -1.0]])
def test_segments_take_linear_time(pattern):
    seconds = []
    for n in (125_000, 1_000_000):
        x = np.tile(pattern, n // 2)
        begin = time.process_time()
        toxicity.maximal_segments(x)
        seconds.append(time.process_time() - begin)
    assert seconds[1] < 30 * max(seconds[0], 0.05)  # eight times the tokens; a quadratic scan would take 64 times as long


def test_toxicity_finds_passages_and_unseen_forms(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("aeioustrnl") for _ in range(draw.randint(2, 6)))
    vocabulary = [word() for _ in range(400)]
    texts, toxic = [], []
    for i in range(900):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(20, 120))]
        bad = i % 5 == 0
        if bad:
            words[7:7] = ["blorg" + draw.choice(["", "ix", "ox", "um"]), "zwurk"]
        texts.append(" ".join(words))
        toxic.append(int(bad))
    docs = rows(spark, [*texts, "so blorgany zwurk " + " ".join(vocabulary[:30]), None, "", " ".join(vocabulary * 500), texts[0], texts[0]], [*range(904), 904, 904])
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(None, 1), (3, None), (5000, 1)], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    held = [i for i in range(900) if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert sum(got[i]["predicted"] == toxic[i] for i in held) >= 0.98 * len(held)
    assert len(got) == 905 and got[903]["predicted"] == 0 and got[904]["score"] == got[0]["score"]
    assert got[900]["predicted"] == 1 and got[901]["predicted"] == got[902]["predicted"] == 0
    hit = next(i for i in held if toxic[i])
    a, b = got[hit]["passages"][0]["start"], got[hit]["passages"][0]["end"]
    assert "blorg" in texts[hit][a:b]
    none = toxicity.score_documents(docs, labels.limit(0)).collect()
    assert {r["predicted"] for r in none} == {0} and len(none) == 906
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_language_model(spark):
    draw = random.Random(9)
    a, b = ["ka", "ke", "ki", "ko"], ["su", "sa", "se", "so"]
    texts = [" ".join(draw.choice(x) for _ in range(draw.randint(3, 40))) for x in (a, b) for _ in range(300)] + ["Ka unseen", None, "", "rare word"]
    got = {r["doc_id"]: r for r in lm.score_documents(rows(spark, texts), classes=5, dimensions=8).collect()}
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in enumerate(texts)}
    count = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) < 1e-8
    held = [i for i in got if got[i]["held_out"]]
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)
    assert lm.score_documents(rows(spark, texts).limit(0)).count() == 0


def plain_fit(q, symbols, counts, every, chosen):
    bias, vectors = np.log(counts / counts.sum()), np.zeros((len(counts), q.shape[1]))
    size = np.mean((q * q).sum(1)) + 1e-9 if len(q) else 1.0
    for _ in range(lm.ROUNDS if len(counts) > 1 else 0):
        gradient = -lm.PRIOR * size * vectors
        for x, y in zip(q, symbols, strict=True):
            p = np.exp(vectors @ x + bias)
            gradient -= np.outer(p / p.sum(), x)
            gradient[y] += x
        vectors = vectors + gradient / ((lm.PRIOR + np.bincount(symbols, minlength=len(counts))) * size)[:, None]
    x = every @ vectors.T + bias
    return x[np.arange(len(x)), chosen] - np.log(np.exp(x).sum(1))


def test_scores_against_plain_sums(spark):
    """Every token's probability by the definition: a softmax over all classes, in groups one over blocks and one over words."""
    draw = random.Random(4)
    texts = [" ".join(f"w{int(draw.paretovariate(0.7)) % 400}" for _ in range(draw.randint(0, 60))) for _ in range(120)] + [None, "new words", "w1"]
    df = rows(spark, [*texts, texts[0]], [*range(len(texts) - 1), None, None]).withColumn("training", F.coalesce(F.col("doc_id") % 5 != 1, F.lit(True)))
    vocab = lm.vocabulary(lm.count_words(df.where("training")), classes=20)
    model = lm.train(df.where("training"), vocab, 6)
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm.score(df, vocab, model).collect())
    assert vocab.groups > 2 and len(got) == len(texts) + 1
    import pyarrow as pa

    tokens = []  # document, word, class, contexts, training
    ids = [*range(len(texts) - 1), None, None]
    for d, text in enumerate([*texts, texts[0]]):
        words, _ = lm.text_tokens(pa.array([text]))
        classes, _ = lm.to_classes(vocab, words)
        before = [lm.end_class(vocab)] * 2 + classes.tolist()
        tokens += [(d, w, c, before[i + 1], before[i], ids[d] is None or ids[d] % 5 != 1) for i, (w, c) in enumerate(zip(words.tolist(), classes.tolist(), strict=True))]
    want = np.zeros(len(ids))
    q = np.array([model.context[a] * model.near + model.context[b] * model.far for *_, a, b, _ in tokens], float)
    for (d, _, c, *_), x in zip(tokens, q, strict=True):
        s = model.target.astype(float) @ x + model.bias
        want[d] += s[c] - np.log(np.exp(s).sum())
    for g in range(vocab.groups):
        mine = [i for i, t in enumerate(tokens) if t[2] == vocab.rare + g]
        if mine:
            learns = np.array([tokens[i][5] for i in mine])
            known = sorted({tokens[i][1] for i in mine if tokens[i][5]})
            symbol = np.array([known.index(tokens[i][1]) if tokens[i][1] in known else len(known) for i in mine])
            counts = np.append([sum(tokens[i][1] == w and tokens[i][5] for i in mine) for w in known], 0) + 0.5
            x = q[mine] - (q[mine][learns].mean(0) if learns.any() else 0)
            width = math.ceil(math.sqrt(len(counts)))
            block = symbol // width
            logs = plain_fit(x[learns], block[learns], np.array([counts[a : a + width].sum() for a in range(0, len(counts), width)]), x, block)
            for b in set(block.tolist()):
                here = block == b
                logs[here] += plain_fit(x[here & learns], symbol[here & learns] - b * width, counts[b * width : (b + 1) * width], x[here], symbol[here] - b * width)
            np.add.at(want, [tokens[i][0] for i in mine], logs)
    found = sorted((str(i), sum(t[0] == d for t in tokens), want[d] / math.log(10)) for d, i in enumerate(ids))
    assert [x[:2] for x in got] == [x[:2] for x in found]
    assert max(abs(a[2] - b[2]) for a, b in zip(got, found, strict=True)) < 1e-3


def test_scores_depend_little_on_the_layout(spark):
    draw = random.Random(6)
    texts = [" ".join(f"w{int(draw.paretovariate(0.8)) % 300}" for _ in range(40)) for _ in range(300)]
    one, many = ({r["doc_id"]: r for r in lm.score_documents(rows(spark, texts).repartition(n), classes=30, dimensions=8).collect()} for n in (1, 5))
    assert all(abs(one[i]["base_score"] - many[i]["base_score"]) < 1e-9 for i in one)
    tokens = sum(r["n_tokens"] for r in one.values())
    assert abs(sum(one[i]["score"] - many[i]["score"] for i in one)) < 0.05 * tokens


def test_words_of_a_group_are_told_apart():
    words = np.array([1, 2] * 200 + [3, 4] * 200, np.uint64)
    q = np.concatenate([np.tile([1.0, 0.0], (400, 1)), np.tile([0.0, 1.0], (400, 1))])
    counts, logs = lm.group_logs(words, np.ones(800, bool), q)
    assert set(counts) == {200} and logs.mean() > np.log(0.4)


def test_group_probabilities_are_normalised():
    draw = np.random.default_rng(2)
    words = draw.integers(1, 30, 400).astype(np.uint64)
    q = draw.normal(size=(400, 3))
    asked = np.arange(0, 30, dtype=np.uint64)  # 0 is unseen
    training = np.append(np.ones(400, bool), np.zeros(30, bool))
    _, logs = lm.group_logs(np.append(words, asked), training, np.concatenate([q, np.tile(q[:1], (30, 1))]))
    assert abs(np.exp(logs[400:]).sum() - 1) < 1e-9


def test_groups_grow_with_the_vocabulary(spark):
    sizes = []
    for n in (100, 10_000):
        counts = spark.range(n).select(F.xxhash64("id").alias("word"), F.lit(2).cast("long").alias("c"))
        vocab = lm.vocabulary(counts, 50)
        sizes.append(len(vocab.class_counts()))
        assert vocab.class_counts().sum() == 2 * n
    assert sizes == [55, 100]


def test_strongest_fills_every_place(spark):
    flat = spark.range(20_000).select(F.col("id").alias("word"), F.lit(3).alias("c"))
    for most in (5, 7_000, 20_000, 30_000):
        got = [r["word"] for r in common.strongest(flat, "c", most).collect()]
        assert len(got) == len(set(got)) == min(most, 20_000)
    mixed = flat.withColumn("c", F.when(F.col("word") < 10, 1000 + F.col("word")).when(F.col("word") < 12_000, 3).otherwise(0))
    got = [r["word"] for r in common.strongest(mixed, "c", 9_000).collect()]
    assert len(set(got)) == 9_000 and set(range(10)) <= set(got) and max(got) < 12_000
    assert sorted(r["word"] for r in common.strongest(mixed, "c", 3).collect()) == [7, 8, 9]


def test_probabilities_are_normalised():
    model = lm.LogBilinear.start(np.arange(1.0, 40.0), 6)
    s1, s2, z = model.log_probabilities()
    p = np.exp(s1[:, None, :] + s2[None, :, :] - z[:, :, None])
    assert np.abs(p.sum(2) - 1).max() < 1e-4
