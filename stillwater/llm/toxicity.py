"""Toxic passages by maximum-scoring segment search.

Training counts tokens (runs of letters, A-Z taken as a-z) in toxic and in clean labelled documents. A token's
score is its log-odds between the two under Dirichlet priors, in two levels: the tokens that begin alike share
a prior from the corpus, and each token is drawn towards the odds of its beginning, so that an unseen form of a
known beginning has a score too. Odds count if they and their z value are high; a fixed drift is taken from every
token's score, so that a random clean text loses score as it goes on.

A text is scanned once for all maximal scoring segments. Their scores are calibrated by extreme-value theory:
lambda solves sum p(s) exp(lambda s) = 1 over the clean tokens, K is fitted on clean texts, and a text of n
tokens has K n exp(-lambda S) segments of score S or more by chance. The r best segments together have the
probability exp(-t) t^(r-1) / r! (r-1)!, t being the sum of their normalised scores; the least such
probability is the text's evidence, and a logistic curve fitted on the labels turns it into a score.

Bounds: the fit reads at most `most_labelled` labelled documents, drawn by a hash of the id, each distinct text
once. The model keeps every token and beginning whose odds count; their number is bounded by that sample, and no
other bound drops any. Counts behind it are made by Spark; scoring covers every row.

Defined cases: a null or empty text has no evidence and so the least score; labels may be null (left out), may
repeat (toxic if any row says so) or lack documents; without labels of both kinds nothing is toxic: the score is
the prior, 0.25; null ids are scored like others (their crc is that of the empty text); empty tables give empty
tables; repeated rows each give a row; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.llm import common

MOST_LABELLED = 200_000
DRIFT, LEAST_Z, LEAST_ODDS, BEGINNING, STRENGTH, SPREAD, LARGEST = 1.0, 5.0, 2.0, 4, 5.0, 100.0, 12.0
SIGNIFICANT = math.log(20)  # evidence of a passage that one clean text in twenty has by chance

_GAP = np.ones(256, bool)
_GAP[128:] = False
_GAP[97:123] = False
_GAP[65:91] = False


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens and of their beginnings, the n + 1 offsets of the texts, and starts and ends in bytes."""
    data, at = common.text_bytes(column)
    starts, ends, first = common.words(data, at, _GAP)
    return common.word_hashes(data, starts, _GAP), common.word_hashes(data, starts, _GAP, BEGINNING), first, starts, ends


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    begin_keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    begin_scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    offset: float = -math.log(3)

    def token_scores(self, hashes: np.ndarray, beginnings: np.ndarray) -> np.ndarray:
        """A token's own score, else that of its beginning, else the cost of the drift."""
        out = _look_up(self.begin_keys, self.begin_scores, beginnings, np.full(len(hashes), -DRIFT))
        return _look_up(self.keys, self.scores, hashes, out)

    def evidence(self, segments: list[float], n: int) -> float:
        """-ln of the least probability of the r best segments, over all r."""
        best, total = 0.0, 0.0
        for r, s in enumerate(sorted(segments, reverse=True), 1):
            x = self.lam * s - self.log_k - math.log(max(n, 1))
            if x <= 0:
                break
            total += x
            best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) if r > 1 else total)
        return best

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * evidence + self.offset))))


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: np.ndarray) -> np.ndarray:
    if not len(keys):
        return default
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of a sequence, in linear time (Ruzzo and Tompa 1999). Each segment
    on the stack knows the nearest one below it with a smaller sum before it. A search follows these links: what lies
    between is never looked at again, so that all searches together take as many steps as there are segments."""
    total = np.append(0.0, np.cumsum(scores))
    at = np.flatnonzero(scores > 0)
    first: list[int] = []
    end: list[int] = []
    before: list[float] = []
    after: list[float] = []
    below: list[int] = []  # -1: none
    for i, low, high in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist(), strict=True):
        start, j = i, len(before) - 1
        while j >= 0 and before[j] >= low:
            j = below[j]
        while j >= 0 and after[j] < high:  # taken in with all above it; the search goes on from its own link
            start, low = first[j], before[j]
            for stack in (first, end, before, after):
                del stack[j:]
            link = below[j]
            del below[j:]
            j = link
        first.append(start)
        end.append(i + 1)
        before.append(low)
        after.append(high)
        below.append(j)
    return [(a, b, y - x) for a, b, x, y in zip(first, end, before, after, strict=True)]


def _count_tokens(labelled: DataFrame) -> DataFrame:
    """(text, toxic) -> token, beginning, toxic, c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text", 4_000_000):
            hashes, beginnings, first, _, _ = tokens(part.column("text"))
            y = np.repeat(np.asarray(part.column("toxic").to_numpy(zero_copy_only=False), np.int64), np.diff(first))
            for label in (0, 1):
                some = y == label
                keys, where, counts = np.unique(hashes[some], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(beginnings[some][where].view(np.int64)), pa.array(np.full(len(keys), label, np.int32)), pa.array(counts.astype(np.int64))], names=["token", "beginning", "toxic", "c"])

    counted = common.map_batches(labelled.select("text", "toxic"), run, "token bigint, beginning bigint, toxic int, c bigint")
    return counted.groupBy("token", "beginning").agg(F.sum(F.col("c") * F.col("toxic")).alias("t"), F.sum(F.col("c") * (1 - F.col("toxic"))).alias("u"))


def _with_odds(df: DataFrame, prior_t, prior_u, n_t: float, n_u: float) -> DataFrame:
    """df with odds, the log-odds of the smoothed counts, and z, the root of the log-likelihood ratio of the plain ones."""
    t, u = F.col("t") + prior_t, F.col("u") + prior_u
    df = df.withColumn("odds", F.log(t / F.lit(n_t)) - F.log(u / F.lit(n_u)))
    expected = (F.col("t") + F.col("u")) * F.lit(n_t / (n_t + n_u))
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    likelihood = part(F.col("t"), expected) + part(F.col("u"), F.col("t") + F.col("u") - expected)
    return df.withColumn("z", F.sqrt(F.greatest(F.lit(0.0), 2 * likelihood)))


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int, training) -> DataFrame:
    """(text, toxic) of at most about `most` labelled documents for which training(doc_id) holds, each text once."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(training("doc_id"))
    known = common.stash(known, "toxic-labels")
    share = min(1.0, most / max(1, known.count()))
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = documents.select("doc_id", "text").where("text is not null").join(known, "doc_id")
    return common.stash(texts.groupBy(F.md5("text").alias("key")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).drop("key"), "toxic-sample")


def fit(documents: DataFrame, labels: DataFrame, training, most_labelled: int = MOST_LABELLED) -> Model:
    """training: the condition on an id column (by name) under which its label may be learnt from."""
    sample = labelled_sample(documents, labels, most_labelled, training)
    counts = common.stash(_count_tokens(sample), "toxic-counts")
    n_t, n_u = counts.agg(F.sum("t"), F.sum("u")).first()
    if not n_t or not n_u:
        return Model()
    beginnings = counts.groupBy("beginning").agg(F.sum("t").alias("t"), F.sum("u").alias("u"))
    fraction = (F.col("t") + F.col("u")) / float(n_t + n_u) * SPREAD
    beginnings = common.stash(_with_odds(beginnings, fraction, fraction, n_t + SPREAD, n_u + SPREAD), "toxic-beginnings")
    ratio = F.exp("begin_odds") * float(n_t)
    of_toxic = ratio / (ratio + float(n_u)) * STRENGTH
    words = counts.join(beginnings.select("beginning", F.col("odds").alias("begin_odds"), F.col("z").alias("begin_z")), "beginning")
    words = _with_odds(words, of_toxic, STRENGTH - of_toxic, n_t, n_u)
    strong = (F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)
    drawn = (F.col("begin_z") >= LEAST_Z) & (F.col("begin_odds") >= LEAST_ODDS)
    value = F.when(strong | drawn, F.least("odds", F.lit(LARGEST))).otherwise(F.lit(0.0)) - F.lit(DRIFT)
    # Tokens whose score is not that of their beginning: strong ones, and any under a strong beginning.
    words = common.stash(words.where(strong | drawn).select("token", value.alias("s"), (F.col("u") + STRENGTH - of_toxic).alias("u"), "z"), "toxic-words")
    # Both hold only what the bounded sample makes significant.
    kept = words.toPandas()
    begin = beginnings.where(strong).select("beginning", "odds").toPandas()
    model = Model()
    model.keys, model.scores = _sorted(kept["token"], kept["s"])
    model.begin_keys, model.begin_scores = _sorted(begin["beginning"], np.minimum(begin["odds"], LARGEST) - DRIFT)
    scored = kept["u"].sum()
    model.lam = _root(np.append(kept["s"], -DRIFT), np.append(kept["u"] / n_u, max(0.0, 1 - scored / n_u)))
    seen = common.stash(evidences(sample, model, ["toxic"]), "toxic-seen")
    # With beta = lambda S - ln n Gumbel-distributed around ln K, its mean is ln K + 0.5772; texts without any segment say nothing.
    clean = seen.where("toxic = 0 and best > 0").agg(F.avg(F.lit(model.lam) * F.col("best") - F.log(F.greatest("n", F.lit(1))))).first()[0]
    model.log_k = min(0.0, (clean if clean is not None else -0.5772) - 0.5772)
    seen = evidences(sample, model, ["toxic"]).select("toxic", (F.round(F.least("evidence", F.lit(64.0)) * 8) / 8).alias("x"))
    table = seen.groupBy("x").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).toPandas()  # 513 rows at most
    model.slope, model.offset = _logistic(table["x"].to_numpy(float), table["t"].to_numpy(float), table["n"].to_numpy(float))
    return model


def _sorted(keys, values) -> tuple[np.ndarray, np.ndarray]:
    keys, values = np.asarray(keys, np.int64).view(np.uint64), np.asarray(values, float)
    order = np.argsort(keys)
    return keys[order], values[order]


def _root(scores: np.ndarray, p: np.ndarray) -> float:
    """The positive lambda with sum p exp(lambda s) = 1."""
    p = p / p.sum()
    low, high = 0.0, 1.0
    f = lambda x: float(np.sum(p * np.exp(np.minimum(600.0, x * scores)))) - 1
    if (scores > 0).sum() == 0:
        return 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if f(middle) < 0 else (low, middle)
    return high


def _logistic(x: np.ndarray, t: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with a weak prior that keeps them finite; the slope is at least 0.05."""
    w = np.array([0.5, -2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -40, 40)))
        g = np.array([np.sum((t - n * p) * x), np.sum(t - n * p)]) - 0.01 * w
        v = n * p * (1 - p)
        h = np.array([[np.sum(v * x * x), np.sum(v * x)], [np.sum(v * x), np.sum(v)]]) + 0.01 * np.eye(2)
        w = w + np.clip(np.linalg.solve(h, g), -2, 2)
    return float(max(0.05, w[0])), float(w[1])


def evidences(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep`, n (tokens), best (the best segment's score), evidence, score, and passages: the
    significant segments as structs (start, end: bytes of the UTF-8 text, score)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    source = documents.select(*keep, "text") if "text" not in keep else documents.select(*keep)
    types = {x.name: x.dataType.simpleString() for x in source.schema}
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in common.slices(batches, "text", 4_000_000):
            hashes, beginnings, first, starts, ends = tokens(part.column("text"))
            scores = model.token_scores(hashes, beginnings)
            data_at = common.text_bytes(part.column("text"))[1]
            n = np.diff(first)
            best, evidence, passages = np.zeros(len(n)), np.zeros(len(n)), [[] for _ in n]
            hot = np.unique(np.searchsorted(first, np.flatnonzero(scores > 0), "right") - 1)
            for i in hot.tolist():
                a, b = int(first[i]), int(first[i + 1])
                found = maximal_segments(scores[a:b])
                best[i] = max(s for _, _, s in found)
                evidence[i] = model.evidence([s for _, _, s in found], b - a)
                passages[i] = [{"start": int(starts[a + x] - data_at[i]), "end": int(ends[a + y - 1] - data_at[i]), "score": s} for x, y, s in found if model.evidence([s], b - a) >= SIGNIFICANT]
            score = [model.score(x) for x in evidence.tolist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(n), pa.array(best), pa.array(evidence), pa.array(score), pa.array(passages, pa.list_(passage))], names=[*keep, "n", "best", "evidence", "score", "passages"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "n bigint, best double, evidence double, score double, passages array<struct<start: bigint, end: bigint, score: double>>"])
    return common.map_batches(source, run, schema)


def score_documents(documents: DataFrame, labels: DataFrame, of: int = 5, held: int = 0, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted, passages of every row; learns from labels outside the held-out fold."""
    model = fit(documents, labels, lambda c: common.crc_bucket(c, of) != held, **bounds)
    scored = evidences(documents, model, ["doc_id"])
    return scored.select("doc_id", (common.crc_bucket("doc_id", of) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")
