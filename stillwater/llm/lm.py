"""Language-model scoring with a log-bilinear neural model, trained by noise-contrastive estimation.

Spark counts every word of the training texts. The model's classes are the most frequent words, the end of a text,
and groups of all other words, to which a hash deals them; the number of groups grows with the square root of the
counted vocabulary. The model predicts a class from the two classes before it: q = c1 * R[w1] + c2 * R[w2] (c1, c2:
weights for each dimension), and s(w) = q . R'[w] + b[w]. Each task trains a copy, from one common start, on all
training texts that it reads, in numpy minibatches with a shared set of noise words; the copies are averaged by Spark,
weighted by their tokens. Since s splits into a part for w1 and one for w2, the normalisers of all pairs of contexts
are one matrix product, exp(S1 + b) exp(S2)^T, so every token gets its class's normalised log-probability from look-ups
in small tables.

Inside a group every word has a vector and a bias of its own: two softmaxes of the same form over the context q, first
over blocks of the group's words and then over the words of the block, so that a normaliser sums over about the root of
the group's size. All tokens of a group meet in one task, which fits them to the training tokens by maximum likelihood
with a ridge prior, from the smoothed unigram shares on, and scores every token. No word is left out, and no task or
driver holds the words of more than one group. A word's probability is its class's times its own in the group; unseen
words are one word more in each group. As contexts, words of a group share the group's vector.

Beside it stands a unigram base: log10((c + 0.5) / (N + 0.5 (V + 1))) for each token. The counts of the most frequent
words are broadcast; those of all others are taken in the groups.

The copies start alike and see what their tasks read, so the model, and with it `score`, depends a little on how the
rows lie in files; counts and base do not, and neither depends on the order in which tasks end.

Defined cases: a null text is the empty text, of one token, the end; null ids belong to the fold of the empty
text; repeated rows each give a row; without training texts every token has base probability 1 / 1 and the model
knows only its special classes; an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.llm import common

CLASSES, DIMENSIONS = 1024, 16
NOISE, BATCH, RATE = 64, 4096, 0.1
#: A word's stand-in for the end of a text; no word is empty, so no word has it.
END = np.uint64(0)


@dataclass
class Vocabulary:
    """Hashes and counts of the head, most frequent first (the end is one of them); totals over all training tokens."""

    head: np.ndarray
    counts: np.ndarray
    tokens: int
    words: int
    classes: int
    groups: int
    group_counts: np.ndarray

    def __post_init__(self):
        self.order = np.argsort(self.head)
        self.sorted = self.head[self.order]

    def rank(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word in the head, or -1."""
        if not len(self.head):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.head) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], -1)

    @property
    def rare(self) -> int:
        """The class of the first group of words beyond the model's most frequent ones."""
        return self.classes

    def group(self, hashes: np.ndarray) -> np.ndarray:
        return hashes.view(np.int64) % self.groups

    def class_counts(self) -> np.ndarray:
        return np.concatenate([self.counts[: self.classes], self.group_counts]).astype(float)


def text_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with an END after each text, and the n + 1 offsets."""
    data, at = common.text_bytes(column)
    starts, _, first = common.words(data, at)
    hashes = common.word_hashes(data, starts)
    n = len(at) - 1
    offsets = first + np.arange(n + 1)
    out = np.full(len(hashes) + n, END, np.uint64)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] - 1] = False
    out[keep] = hashes
    return out, offsets


def count_words(texts: DataFrame, most_held: int = 300_000) -> DataFrame:
    """(text) -> word (a hash), c. A task sums up what it has seen whenever it holds most_held words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            words = np.concatenate([w for w, _ in held])
            counts = np.concatenate([c for _, c in held])
            order = np.argsort(words, kind="stable")
            words, counts = words[order], counts[order]
            first = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
            return words[first], np.add.reduceat(counts, first)

        def rows():
            words, counts = merged()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64))], names=["word", "c"])

        for part in common.slices(batches, "text", 4_000_000):
            held.append(np.unique(text_tokens(part.column("text"))[0], return_counts=True))
            if sum(len(w) for w, _ in held) > 2 * most_held:
                one = merged()
                held[:] = [one]
                if len(one[0]) > most_held:
                    yield rows()
        if held:
            yield rows()

    return common.map_batches(texts.select("text"), run, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, classes: int = CLASSES) -> Vocabulary:
    """The `classes` most frequent words, and groups for the others."""
    tokens, words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = common.strongest(counts, "c", classes).toPandas().sort_values(["c", "word"], ascending=[False, True])
    groups = max(1, int(np.sqrt(words) / 2))
    in_groups = np.zeros(groups, np.int64)
    for g, c in counts.groupBy(F.pmod("word", F.lit(groups)).alias("g")).agg(F.sum("c")).collect():
        in_groups[g] = c
    known, c = top["word"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
    np.subtract.at(in_groups, known % groups, c)
    return Vocabulary(known.view(np.uint64), c, int(tokens), int(words), len(top), groups, in_groups)


# --------------------------------------------------------------------------- the model


@dataclass
class LogBilinear:
    context: np.ndarray  # R, a row for each class
    target: np.ndarray  # R'
    near: np.ndarray  # c1
    far: np.ndarray  # c2
    bias: np.ndarray

    @classmethod
    def start(cls, counts: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 11) -> LogBilinear:
        """The unigram distribution, and small random vectors."""
        draw = np.random.default_rng(seed)
        n = len(counts)
        p = (counts + 0.5) / (counts.sum() + 0.5 * n)
        return cls(draw.normal(0, 0.3, (n, dimensions)).astype(np.float32), draw.normal(0, 0.05, (n, dimensions)).astype(np.float32), np.ones(dimensions, np.float32), np.ones(dimensions, np.float32) / 2, np.log(p).astype(np.float32))

    def parameters(self) -> tuple[np.ndarray, ...]:
        return self.context, self.target, self.near, self.far, self.bias

    def copy(self) -> LogBilinear:
        return LogBilinear(*(x.copy() for x in self.parameters()))

    def log_probabilities(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """S1 + b, S2 (a row for each context class, a column for each target), and the log normalisers of context pairs."""
        one = (self.context * self.near) @ self.target.T + self.bias
        two = (self.context * self.far) @ self.target.T
        top1, top2 = one.max(1, keepdims=True), two.max(1, keepdims=True)
        z = np.log(np.maximum(np.exp(one - top1) @ np.exp(two - top2).T, 1e-37)) + top1 + top2.T
        return one, two, z

    def train(self, target: np.ndarray, one: np.ndarray, two: np.ndarray, noise: np.ndarray, log_noise: np.ndarray, squares: list[np.ndarray]) -> None:
        """A step of noise-contrastive estimation on a minibatch: each observed class against the shared
        noise classes. squares: the sums of squared gradients so far, a sum for each parameter."""
        a, b = self.context[one], self.context[two]
        q = a * self.near + b * self.far
        r, rn = self.target[target], self.target[noise]
        k = len(noise)
        real = np.einsum("ij,ij->i", q, r) + self.bias[target] - log_noise[target] - np.float32(np.log(k))
        gf = (-q) @ rn.T  # minus the logit of each noise class, and then in place
        gf -= self.bias[noise] - log_noise[noise] - np.float32(np.log(k))
        gr = 1 / (1 + np.exp(np.clip(real, -30, 30)))  # 1 - sigmoid
        np.clip(gf, -30, 30, out=gf)
        np.exp(gf, out=gf)
        gf += 1
        np.divide(-1, gf, out=gf)
        gq = gr[:, None] * r + gf @ rn
        n = len(self.bias)
        d_target = _scatter(target, gr[:, None] * q, n)
        np.add.at(d_target, noise, gf.T @ q)
        d_bias = np.bincount(target, gr, n)
        np.add.at(d_bias, noise, gf.sum(0))
        d_context = _scatter(one, gq * self.near, n) + _scatter(two, gq * self.far, n)
        gradients = d_context, d_target, np.einsum("ij,ij->j", gq, a), np.einsum("ij,ij->j", gq, b), d_bias
        for x, g, s in zip(self.parameters(), gradients, squares, strict=True):  # Adagrad
            s += g * g
            x += RATE * g / np.sqrt(s + 1e-6)


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values by row."""
    d = values.shape[1]
    return np.bincount((rows[:, None] * d + np.arange(d)).ravel(), values.ravel(), n * d).reshape(n, d).astype(np.float32)


def contexts(classes: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two places before each token; before its beginning a text has the end of another."""
    one, two = np.empty_like(classes), np.empty_like(classes)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    begin = offsets[:-1]
    one[begin] = end
    two[begin] = end
    second = begin[offsets[1:] - begin > 1] + 1
    two[second] = end
    return one, two


def to_classes(vocab: Vocabulary, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each token, and its place in the head or -1."""
    rank = vocab.rank(hashes)
    return np.where(rank < 0, vocab.rare + vocab.group(hashes), rank), rank


def end_class(vocab: Vocabulary) -> int:
    return int(to_classes(vocab, np.array([END], np.uint64))[0][0])


# --------------------------------------------------------------------------- inside a group

PRIOR, ROUNDS, ROWS_AT_ONCE = 8.0, 4, 2048


def _chunks(n: int, m: int) -> Iterator[slice]:
    """Slices of n rows against m columns that stay within a core's cache."""
    step = max(64, ROWS_AT_ONCE * 64 // max(64, m))
    return (slice(at, min(n, at + step)) for at in range(0, n, step))


class _Exponentials:
    """exp of contexts (with a last column of ones) against vectors and biases, chunk by chunk in one buffer. Logits far beyond
    any fitted value are cut; norms tell whether there can be any."""

    def __init__(self, q: np.ndarray, m: int):
        self.q, self.norm = q, float(np.sqrt(np.einsum("ij,ij->i", q, q).max(initial=0.0)))
        self.buffer = np.empty((max((c.stop - c.start for c in _chunks(len(q), m)), default=0), m), q.dtype)
        self.ones = np.ones(m, q.dtype)

    def __call__(self, c: slice, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chunk's contexts, their exponentials and the sums of these; the buffer is used again."""
        q = self.q[c]
        x = np.matmul(q, weights, out=self.buffer[: len(q)])
        if self.norm * float(np.sqrt(np.einsum("ij,ij->j", weights, weights).max())) > 80:
            np.clip(x, -80, 80, out=x)
        np.exp(x, out=x)
        return q, x, x @ self.ones


def _fit(q: np.ndarray, symbols: np.ndarray, counts: np.ndarray, every: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """A softmax over len(counts) symbols (counts: smoothed), fitted to the training pairs (q, symbols), which come sorted by
    symbol; the log-probability of each chosen symbol in its context of `every`. q, every: with a last column of ones. Steps
    are Newton's with the curvature's bound by each symbol's count, and a ridge prior of PRIOR tokens."""
    m, d = len(counts), q.shape[1] - 1
    weights = np.zeros((d + 1, m), np.float32)
    weights[d] = np.log(counts / counts.sum())
    if len(symbols) and m > 1:
        size = float(np.einsum("ij,ij->", q[:, :d], q[:, :d], dtype=np.float64) / len(q)) + 1e-9
        seen = np.bincount(symbols, minlength=m)
        first = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
        fitted = _Exponentials(q, m)
        observed = np.zeros((m, d))
        observed[symbols[first]] = np.add.reduceat(q[:, :d], first, axis=0, dtype=np.float64)
        for k in range(ROUNDS):
            expected = np.zeros((m, d))
            if k == 0:  # without vectors every context has the same probabilities
                expected += np.outer(counts / counts.sum(), q[:, :d].sum(0, dtype=np.float64))
            else:
                for c in _chunks(len(q), m):
                    here, p, sums = fitted(c, weights)
                    expected += p.T @ (here[:, :d] / sums[:, None])
            vectors = weights[:d].T.astype(np.float64)
            vectors += (observed - expected - PRIOR * size * vectors) / ((PRIOR + seen) * size)[:, None]
            weights[:d] = vectors.T
    out, scored = np.empty(len(every)), _Exponentials(every, m)
    for c in _chunks(len(every), m):
        _, x, sums = scored(c, weights)
        out[c] = np.log(x[np.arange(len(x)), chosen[c]].astype(np.float64) / sums)
    return out


def group_logs(words: np.ndarray, training: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a group -> the count of each one's word in training, and its natural log-probability in the group."""
    known, counts = np.unique(words[training], return_counts=True)
    at = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
    symbol = np.where(known[at] == words, at, len(known)) if len(known) else np.zeros(len(words), np.int64)
    c = np.append(counts, 0)  # the last symbol stands for all unseen words
    width = int(np.ceil(np.sqrt(len(c))))
    order = np.argsort(symbol, kind="stable")
    symbol, learns = symbol[order], training[order]
    extended = np.ones((len(q), q.shape[1] + 1), np.float32)
    extended[:, :-1] = (q - q[training].mean(0) if training.any() else q)[order]
    block = symbol // width
    weights = np.add.reduceat(c + 0.5, np.arange(0, len(c), width))
    logs = _fit(extended[learns], block[learns], weights, extended, block)
    begin = np.searchsorted(block, np.arange(len(weights) + 1))
    for b in range(len(weights)):
        here = slice(begin[b], begin[b + 1])
        if begin[b] < begin[b + 1]:
            inner, mine = symbol[here] - b * width, learns[here]
            logs[here] += _fit(extended[here][mine], inner[mine], c[b * width : (b + 1) * width] + 0.5, extended[here], inner)
    out, times = np.empty(len(q)), np.empty(len(q), np.int64)
    out[order], times[order] = logs, c[symbol]
    return times, out


#: What tokens in a group take along: each word with the length of its run; the step in rows from the token before, and the
#: classes of the contexts. What comes back: the count of each run's word; the steps, and the log-probabilities.
_RUNS, _TOKENS = [("word", "<u8"), ("length", "<u4")], [("step", "<u4"), ("one", "<u4"), ("two", "<u4")]
_COUNTS, _FOUND = [("count", "<u8")], [("step", "<u4"), ("log", "<f4")]


def pack(kinds: list[tuple[str, str]], arrays: list[np.ndarray]) -> bytes:
    """Column by column, and in each byte by byte, so that leading zeros compress away."""
    return zlib.compress(b"".join(np.ascontiguousarray(np.ascontiguousarray(x, kind).view(np.uint8).reshape(len(x), -1).T).tobytes() for (_, kind), x in zip(kinds, arrays, strict=True)), 1)


def unpack(kinds: list[tuple[str, str]], data: bytes) -> list[np.ndarray]:
    data = zlib.decompress(data)
    n, at, out = len(data) // sum(np.dtype(k).itemsize for _, k in kinds), 0, []
    for _, kind in kinds:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * width
    return out


def packed_groups(words: np.ndarray, group: np.ndarray, row: np.ndarray, learns: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[dict]:
    """Tokens as a struct for each group: g, learning (the number of tokens of training texts, which come first), runs, tokens."""
    if not len(words):
        return []
    # By group, then training first, then words by their first 40 bits: equal ones lie together, others almost always apart.
    order = np.argsort((group.astype(np.uint64) << np.uint64(1) | ~learns) << np.uint64(40) | words >> np.uint64(24))
    words, group, row, learns, one, two = (x[order] for x in (words, group, row, learns, one, two))
    new = np.append(True, (words[1:] != words[:-1]) | (learns[1:] != learns[:-1]) | (group[1:] != group[:-1]))
    runs = np.flatnonzero(new)
    lengths = np.diff(np.append(runs, len(words)))
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    step = np.diff(row, prepend=0)
    step[first] = row[first]
    step = step.astype(np.uint32)  # steps may go back, modulo 2**32
    learning = np.add.reduceat(learns.astype(np.int64), first)
    at, end = np.searchsorted(runs, first), np.append(first[1:], len(words))
    out = []
    for g, m, a, b, x, y in zip(group[first].tolist(), learning.tolist(), first.tolist(), end.tolist(), at.tolist(), [*at[1:].tolist(), len(runs)], strict=True):
        out.append({"g": g, "learning": m, "runs": pack(_RUNS, [words[runs[x:y]], lengths[x:y]]), "tokens": pack(_TOKENS, [step[a:b], one[a:b], two[a:b]])})
    return out


def score_groups(packed: DataFrame, model: LogBilinear) -> DataFrame:
    """slice and packed_groups() -> row, known, log_count, inner: sums over the tokens of each row that are in groups."""
    shared = packed.sparkSession.sparkContext.broadcast(model)

    def inside(batch: pa.Table) -> pa.Table:
        model = shared.value
        runs = [unpack(_RUNS, x) for x in batch.column("runs").to_pylist()]
        parts = [unpack(_TOKENS, x) for x in batch.column("tokens").to_pylist()]
        sizes = [len(p[0]) for p in parts]
        word = np.concatenate([np.repeat(*r) for r in runs])
        one, two = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        training = np.concatenate([np.arange(n) < m for n, m in zip(sizes, batch.column("learning").to_pylist(), strict=True)])
        # In an order that does not depend on how the slices came in.
        order = np.lexsort((training.astype(np.uint64) << np.uint64(62) | one.astype(np.uint64) << np.uint64(31) | two, word))
        q = model.context[one[order]] * model.near + model.context[two[order]] * model.far
        count, log = np.empty(len(word), np.int64), np.empty(len(word))
        count[order], log[order] = group_logs(word[order], training[order], q)
        at = np.append(0, np.cumsum(sizes))
        counts = [pack(_COUNTS, [count[a + np.cumsum(r[1], dtype=np.int64) - r[1].astype(np.int64)]]) for a, r in zip(at[:-1], runs, strict=True)]
        found = [pack(_FOUND, [p[0], log[a:b]]) for p, a, b in zip(parts, at[:-1], at[1:], strict=True)]
        return pa.table({"slice": batch.column("slice"), "lengths": pa.array([pack(_RUNS[1:], [r[1]]) for r in runs], pa.binary()), "counts": pa.array(counts, pa.binary()), "found": pa.array(found, pa.binary())})

    def together(batch: pa.Table) -> pa.Table:
        parts = [unpack(_FOUND, x) for x in batch.column("found").to_pylist()]
        row = np.concatenate([np.cumsum(p[0], dtype=np.uint32) for p in parts])
        log = np.concatenate([p[1] for p in parts])
        count = np.concatenate([np.repeat(unpack(_COUNTS, c)[0], unpack(_RUNS[1:], n)[0]) for c, n in zip(batch.column("counts").to_pylist(), batch.column("lengths").to_pylist(), strict=True)])
        rows, at = np.unique(row, return_inverse=True)
        logs = np.where(count > 0, np.log10(count + 0.5), np.log10(0.5))
        sums = [np.bincount(at, x, len(rows)) for x in (count > 0, logs, log.astype(np.float64) / np.log(10))]
        start = batch.column("slice")[0].as_py()
        return pa.table({"row": pa.array(rows.astype(np.int64) + start), "known": pa.array(sums[0].astype(np.int64)), "log_count": pa.array(sums[1]), "inner": pa.array(sums[2])})

    grouped = packed.groupBy("g").applyInArrow(inside, "slice bigint, lengths binary, counts binary, found binary")
    return grouped.groupBy("slice").applyInArrow(together, "row bigint, known bigint, log_count double, inner double")


# --------------------------------------------------------------------------- training and scoring


def train(texts: DataFrame, vocab: Vocabulary, dimensions: int = DIMENSIONS) -> LogBilinear:
    """The average of the copies that the tasks train on their texts."""
    start = LogBilinear.start(vocab.class_counts(), dimensions)
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((start, vocab))
    names = [f"x{i}" for i in range(2 * dimensions + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, vocab = shared.value
        model, end, done = start.copy(), end_class(vocab), 0
        p = (vocab.class_counts() + 0.5) ** 0.75
        p /= p.sum()
        log_noise, total = np.log(p).astype(np.float32), np.cumsum(p)
        draw = np.random.default_rng(5)
        squares = [np.zeros_like(x) for x in model.parameters()]
        for part in common.slices(batches, "text", 2_000_000):
            hashes, offsets = text_tokens(part.column("text"))
            classes, _ = to_classes(vocab, hashes)
            one, two = contexts(classes, offsets, end)
            order = draw.permutation(len(classes))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                noise = np.minimum(np.searchsorted(total, draw.random(NOISE)), len(p) - 1)
                model.train(classes[some], one[some], two[some], noise, log_noise, squares)
                done += len(some)
        if done:
            rows = np.concatenate([model.context, model.target, model.bias[:, None]], 1)
            both = np.concatenate([model.near, model.far, np.zeros(1, np.float32)])[None, :]
            values = np.concatenate([rows, both]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(np.full(len(values), float(done))), *(pa.array(np.ascontiguousarray(c)) for c in values.T)], names=["row", "w", *names])

    copies = common.map_batches(texts.select("text"), run, "row bigint, w double, " + ", ".join(f"{n} double" for n in names))
    mean = copies.groupBy("row").agg(*[F.round(F.sum(F.col(n) * F.col("w")) / F.sum("w"), 5).alias(n) for n in names])
    values = mean.orderBy("row").toPandas()[names].to_numpy(np.float32)  # a row for each class, whatever the data
    if not len(values):
        return start
    d = dimensions
    return LogBilinear(np.ascontiguousarray(values[:-1, :d]), np.ascontiguousarray(values[:-1, d : 2 * d]), values[-1, :d], values[-1, d : 2 * d], values[:-1, 2 * d])


_tables: dict = {}


def score(documents: DataFrame, vocab: Vocabulary, model: LogBilinear) -> DataFrame:
    """(doc_id, text, training) -> doc_id, n_tokens, n_known, base_score, score."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((vocab, model))
    key = uuid.uuid4().hex  # of this model, in whatever worker
    names = ["doc_id", "n_tokens", "n_head", "head_log", "model_log", "packed"]
    struct = pa.struct([("g", pa.int64()), ("learning", pa.int64()), ("runs", pa.binary()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model = shared.value
        if key not in _tables:
            _tables.clear()
            _tables[key] = model.log_probabilities()
        s1, s2, z = _tables[key]
        end = end_class(vocab)
        logs = np.log10(np.append(vocab.counts, 0) + 0.5)  # the last is for words in groups
        logs[-1] = 0
        for part in common.slices(batches, "text", 4_000_000):
            hashes, offsets = text_tokens(part.column("text"))
            classes, rank = to_classes(vocab, hashes)
            one, two = contexts(classes, offsets, end)
            begin, n = offsets[:-1], np.diff(offsets)
            lp = (s1[one, classes] + s2[two, classes] - z[one, two]).astype(np.float64)
            sums = [np.add.reduceat(x, begin) for x in ((rank >= 0).astype(np.int64), logs[rank], lp / np.log(10))]
            learns = part.column("training").to_numpy(zero_copy_only=False)
            rest = np.flatnonzero(rank < 0)
            row = np.searchsorted(offsets, rest, "right") - 1
            blobs = packed_groups(hashes[rest], classes[rest] - vocab.rare, row, learns[row], one[rest], two[rest])
            packed = pa.array([blobs, *[None] * (len(n) - 1)], pa.list_(struct))  # with the slice's first row
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *(pa.array(x) for x in sums), packed], names=names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    made = common.map_batches(documents.select("doc_id", "text", "training"), run, f"doc_id {kind}, n_tokens bigint, n_head bigint, head_log double, model_log double, packed array<struct<g: bigint, learning: bigint, runs: binary, tokens: binary>>")
    # Row numbers rise by one in a partition, so a slice's rows follow that of its first.
    made = common.stash(made.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    packed = made.where("packed is not null").select(F.col("row").alias("slice"), F.explode("packed").alias("p")).select("slice", "p.g", "p.learning", "p.runs", "p.tokens")
    both = made.drop("packed").join(score_groups(packed, model), "row", "left").na.fill(0, ["known"]).na.fill(0.0, ["log_count", "inner"])
    total = np.log10(vocab.tokens + 0.5 * (vocab.words + 1))
    base = F.col("head_log") + F.col("log_count") - F.col("n_tokens") * F.lit(float(total))
    return both.select("doc_id", "n_tokens", (F.col("n_head") + F.col("known")).alias("n_known"), F.round(base, 9).alias("base_score"), F.round(F.col("model_log") + F.col("inner"), 9).alias("score"))  # sums may come in any order


def score_documents(documents: DataFrame, of: int = 5, held: int = 1, classes: int = CLASSES, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from the rows outside the fold `held`."""
    training = documents.where(common.crc_bucket("doc_id", of) != held)
    counts = common.stash(count_words(training), "lm-counts")
    vocab = vocabulary(counts, classes)
    model = train(training, vocab, dimensions)
    held_out = common.crc_bucket("doc_id", of) == held
    scored = score(documents.select("doc_id", "text", (~held_out).alias("training")), vocab, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(vocab.tokens).cast("long").alias("train_tokens"), "base_score", "score")
