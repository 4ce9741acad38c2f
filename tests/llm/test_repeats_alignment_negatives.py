"""Suffix arrays and repeated passages, alignment of two tokenizers, hard negatives."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stillwater.llm import alignment, negatives, suffixes

# --------------------------------------------------------------------------- suffix arrays


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text("abc", max_size=20), min_size=1, max_size=4), min_size=1, max_size=5))
def test_suffix_arrays_are_sorted(texts):
    data = np.array([c for strings in texts for s in strings for c in [*map(ord, s), 0]], np.int64)
    begin = np.cumsum([0] + [sum(len(s) + 1 for s in strings) for strings in texts])
    found = suffixes.suffix_arrays(data, begin)

    def suffix(i):
        end = i + int(np.argmax(data[i:] == 0))
        return data[i:end].tolist()

    for a, b in zip(begin[:-1], begin[1:], strict=True):
        mine = found[a:b].tolist()
        assert sorted(mine) == list(range(a, b))
        assert [suffix(i) for i in mine] == sorted(map(suffix, mine))


def plain_removal(rows, least=100):
    """The definition, window by window: rows (id, text) -> (n_bytes, n_removed, n_spans, digest) of each distinct row."""
    seen, out = set(), {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0], r[1] or "")):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - least + 1):
            if raw[i : i + least] in seen:
                gone[i : i + least] = b"\1" * least
            seen.add(raw[i : i + least])
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out[doc, text] = (len(raw), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def words(rng, n):
    return " ".join("".join(rng.choice(("th", "e", "ing", "an", "ré", "on")) for _ in range(rng.randint(1, 4))) for _ in range(n))


def repeated_rows(seed=3):
    rng = random.Random(seed)
    passage, line = words(rng, 60), words(rng, 9)[:60]
    rows = [(i, words(rng, rng.randint(1, 90))) for i in range(40)]
    rows += [(100 + i, words(rng, rng.randint(0, 12)) + " " + passage[rng.randint(0, 30) :] + " " + words(rng, rng.randint(0, 12))) for i in range(25)]
    rows += [(200 + i, words(rng, 8) + line + words(rng, 8)) for i in range(25)]  # a frequent line shorter than a window
    rows += [(300 + i, rows[3][1]) for i in range(10)]  # copies
    rows += [(400, "a" * 900), (401, "a" * 99), (402, "a" * 100), (403, "ab" * 200), (404, "xyz" * 40 + words(rng, 5)), (405, "a" * 350 + "b" * 350)]
    rows += [(500, None), (501, ""), (502, "short"), (503, words(rng, 3000)), (504, "é" * 200)]
    return rows


def removed(spark, rows, **more):
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id bigint, text string, n_bytes bigint")
    return suffixes.remove_repeats(df, **more).collect()


def test_repeats_as_defined(spark):
    rows = repeated_rows()
    want = plain_removal(rows)
    got = removed(spark, rows)
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert tuple(r)[1:5] == want[r.doc_id, texts[r.doc_id]], r.doc_id


def test_repeats_where_keys_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PART", 3)
    monkeypatch.setattr(suffixes, "CHUNK", 2_000)
    rows = repeated_rows(4)
    want, texts = plain_removal(rows), dict(rows)
    assert all(tuple(r)[1:5] == want[r.doc_id, texts[r.doc_id]] for r in removed(spark, rows))


def test_repeats_of_rows_that_share_an_id(spark):
    """Equal rows get one result; rows of one id and of null ids are in some order of their own, nulls last."""
    rng = random.Random(5)
    one, two = words(rng, 40), words(rng, 40)
    got = removed(spark, [(7, one), (7, one), (3, one + two), (None, one), (None, two)])
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.n_bytes, r.n_removed))
    assert by[3] == [(len((one + two).encode()), 0)]
    assert by[7] == [(len(one.encode()),) * 2] * 2
    assert sorted(by[None]) == sorted([(len(one.encode()),) * 2, (len(two.encode()),) * 2])


def test_repeats_of_nothing(spark):
    assert removed(spark, []) == []
    assert [tuple(r)[1:4] for r in removed(spark, [(1, None)])] == [(0, 0, 0)]
    with pytest.raises(ValueError):
        removed(spark, [(1, "a")], least=40)


def test_kept_text(spark):
    rng = random.Random(6)
    one, two = words(rng, 40), words(rng, 5)
    kept = {r.doc_id: bytes(r.kept) for r in removed(spark, [(1, one), (2, two + one + two)], keep_text=True)}
    assert kept[1] == one.encode() and kept[2] == (two + two).encode()


# --------------------------------------------------------------------------- alignment


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"), p.PATTERN


def plain_alignment(texts, files):
    """By the libraries themselves, token by token."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first, letters = Tokenizer.from_file(files[0]), alignment.byte_letters()
    first.encode_special_tokens = True
    second = SentencePieceProcessor(model_file=files[1])
    piece = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for text in texts:
        a = first.encode(" " + (text or ""), add_special_tokens=False)
        a = [(i, bytes(letters[c] for c in t)) for i, t in zip(a.ids, a.tokens, strict=True)]
        b = [(i, piece(i)) for i in second.encode(text or "")]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
            docs.append(([], [], []))
            continue
        groups, i, j, at_a, at_b = [([], [])], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if j == len(b) or i < len(a) and at_a <= at_b:
                groups[-1][0].append(a[i][0])
                at_a, i = at_a + len(a[i][1]), i + 1
            else:
                groups[-1][1].append(b[j][0])
                at_b, j = at_b + len(b[j][1]), j + 1
            if at_a == at_b and groups[-1][0] and groups[-1][1]:
                groups.append(([], []))
        docs.append(([i for i, _ in a], [i for i, _ in b], groups[:-1]))
    links = [[(x, y) for g in d[2] for x in g[0] for y in g[1]] for d in docs]
    counts = Counter(pair for one in links for pair in set(one))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for (a, b, groups), one in zip(docs, links, strict=True):
        line = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((len(a), len(b), len(groups), len(one), sum(counts[p] == best[p[0]] for p in one), sum(counts[p] for p in one), hashlib.sha256(line.encode()).hexdigest() if a else ""))
    return out


ODD = [None, "", " ", "  two  spaces ", "plain words here", "<|endoftext|> and </s> <unk> <0x41>", "▁ a piece's space", "naïve café Ünïcode", "日本語のテキスト", "🙂🙃 emoji\n\n\ttabs", "\x00nul", "a" * 500, "!?" * 300, "1234567890" * 20, "plain words here", " ﷽ ﬁ ligature", "x y​z"]


def test_alignment_as_defined(spark, tokenizers):
    rng = random.Random(8)
    texts = ODD + [words(rng, rng.randint(1, 60)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, slice int").repartition(3)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.align(df, *tokenizers).collect()}
    want = plain_alignment(texts, tokenizers)
    for i, t in enumerate(texts):
        assert got[i] == want[i], t
    assert sum(w[0] > 0 for w in want) > 60


def test_alignment_does_not_depend_on_slices(spark, tokenizers, monkeypatch):
    rng = random.Random(9)
    texts = ODD + [words(rng, 30) for _ in range(20)]
    monkeypatch.setattr(alignment, "SLICE", 200)
    monkeypatch.setattr(alignment, "PIECE", 50)
    monkeypatch.setattr(alignment, "LARGE", 1)
    df = spark.createDataFrame([(None, t) for t in texts] + [(1, texts[4])] * 2, "doc_id bigint, text string").coalesce(2)
    got = sorted((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.align(df, *tokenizers).collect())
    assert got == sorted(plain_alignment(texts + [texts[4]] * 2, tokenizers))


def test_alignment_of_long_runs_and_nothing(spark, tokenizers):
    assert alignment.align(spark.createDataFrame([], "doc_id bigint, text string"), *tokenizers).collect() == []
    texts = ["\n" * 400_000 + "end", "ab" * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.align(df, *tokenizers).collect()}
    assert [got[i] for i in range(2)] == plain_alignment(texts, tokenizers)


# --------------------------------------------------------------------------- hard negatives


def plain_negatives(rows, is_anchor, positives=5, negatives_=5, percent=80):
    """rows: (id, label, vector of integers)."""
    out = []
    dot = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True))
    for a, label, v in rows:
        if not is_anchor(a):
            continue
        others = sorted((-dot(v, w), i, k) for i, k, w in rows if i != a and len(w) == len(v))
        for s, p in [(-s, i) for s, i, k in others if k == label][:positives]:
            inside = [(-x, i) for x, i, k in others if k != label and percent * s <= 100 * -x <= 100 * s]
            out += [(a, p, r + 1, i, s, x) for r, (x, i) in enumerate(inside[:negatives_])]
    return sorted(out)


def mined(spark, made, **more):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(made, "vec_id bigint, label int, embedding array<double>, key int, d int")
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 5 == 0, F.col("label"), **more).collect())


def test_negatives_as_defined(spark):
    rng = random.Random(10)
    rows = []
    for i in range(300):
        base = rng.choice((-1, 0, 1, 1))
        rows.append((i, rng.randint(0, 3), [float(base + rng.randint(-2, 2)) for _ in range(7)]))
    rows += [(300 + i, i % 2, [1.0] * 7) for i in range(40)] + [(400 + i, i % 2, [1.0, 2.0]) for i in range(30)]
    whole = [(i, k, [int(256 * x) for x in v]) for i, k, v in rows]
    spoilt = [(5, None, [1.0] * 7), (None, 1, [1.0] * 7), (1000, 1, None), (1005, 1, [1.0, None]), (1010, 1, [float("nan")]), (1015, 1, [float("inf")]), (1020, 1, [1e300])]
    given_ = [(*r, 0, 0) for r in rows + rows[:20] + spoilt]  # repeated rows, and names that the operator uses
    want = plain_negatives(whole, lambda i: i % 5 == 0)
    assert len(want) > 500
    assert mined(spark, given_) == want
    assert mined(spark, given_, rows=16, anchor_rows=3) == want


def test_negatives_of_little(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0], 0, 0)]) == []
    assert mined(spark, [(0, 1, [], 0, 0), (1, 1, [], 0, 0), (2, 2, [], 0, 0)]) == [(0, 1, 1, 2, 0, 0)]
    assert mined(spark, [(0, 1, [1.0], 0, 0), (1, 1, [-1.0], 0, 0), (2, 2, [-1.0], 0, 0)]) == []  # no score is above a negative one's 80 %


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(11)
    vectors = rng.integers(-200, 200, (4_000, 33))
    block = negatives.Block.of(np.arange(4_000), rng.integers(0, 5, 4_000).astype(np.int32), vectors)
    for anchor in vectors[:20]:
        least, most = negatives.bounds(anchor, block.codes, block.low, block.high)
        scores = block.vectors @ anchor
        assert (least <= scores).all() and (scores <= most).all()
    block.scored = 0
    for anchor in vectors[:20]:
        block.positives(-1, 2, anchor, 5)
    assert block.scored < 20 * 800 / 5  # of some 800 rows of the label


def test_segments_without_equal_windows_need_no_array(monkeypatch):
    """Segments of one key whose surroundings differ go to no suffix array; those that share a window do, and it is found."""
    draw = np.random.default_rng(5)
    gram = bytes(draw.integers(1, 256, suffixes.GRAM, dtype=np.uint8))
    some = lambda n: bytes(draw.integers(1, 256, n, dtype=np.uint8))
    shared = some(30) + gram + some(38)
    rows = [some(40) + gram + some(60) for _ in range(50)] + [some(20) + shared, shared + some(9)]
    key = int(suffixes._gram_hashes(np.frombuffer(gram, np.uint8)).view(np.int64)[0])
    n, same = len(rows), lambda v, kind: pa.array([v] * len(rows), kind)
    table = pa.table({"key": same(key, pa.int64()), "part": same(0, pa.int32()), "parts": same(1, pa.int32()), "doc": pa.array(range(n)), "tie": same(0, pa.int64()), "start": same(0, pa.int32()), "bytes": pa.array(rows, pa.binary())})
    seen, kept = [], suffixes.suffix_arrays
    monkeypatch.setattr(suffixes, "suffix_arrays", lambda data, begin: seen.append(len(data)) or kept(data, begin))
    got = suffixes._compared(table, 100).to_pylist()
    assert [(r["again"], r["doc"], r["begin"], r["stop"]) for r in got] == [(True, 51, 0, 100)]
    assert seen == [120 + 109 + 2]
