"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

A task encodes its texts by both tokenizers (A: a byte-level BPE; B: a piece model, which writes a space before the text, so A
is given one too). Two pointers over the sorted cumulative ends of A's and of B's tokens meet at the offsets where both end,
which cut the tokens into groups; every A token of a group is linked with every B token of it. The merge is done for all
documents of a slice of text at once, as one search of sorted ends in sorted ends. A slice of about SLICE bytes counts in how
many of its documents each id pair is linked, so Spark counts pairs by slice and not by document; the counts over all
documents, and the highest count of each A id and each B id, are joined back to the slices that hold the pair, and summed up
over each document's links. A pair that is in every document has one row for each slice.

Defined cases: a null or empty text, and one whose joined A or B bytes are not the space and the text, has no tokens: all its
numbers are 0 and groups_sha256 is ''; special tokens' strings are plain text; each row counts as a document, whatever its id,
and ids may be null; an empty table gives an empty table; only the id and text columns are read. Counts are exact. A task
holds the links of a slice, or of one longer text; groups of very many tokens are expanded by their distinct ids.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.llm import common

#: Bytes of text whose pairs are counted together, and of which tokens are held at a time.
SLICE, PIECE = 8_000_000, 1_000_000
#: Links of a group beyond which it is expanded by distinct ids.
LARGE = 4_096


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Encodes by a byte-level vocabulary file. Where its merges are in the order of their tokens' ids, ids are ranks, and the
    faster library of ranks encodes; else, and for texts that this one cannot take, the file's own library does."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary, letters = file["model"]["vocab"], byte_letters()
        self.texts = {i: bytes(map(letters.__getitem__, t)) for t, i in vocabulary.items() if all(c in letters for c in t)}
        self.size = max(vocabulary.values()) + 1
        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        made = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in file["model"]["merges"]]
        before = file.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not file.get("normalizer")
        self.ranks = None
        if plain and made == sorted(made) and len(self.texts) == len(vocabulary):
            import tiktoken

            self.ranks = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks={t: i for i, t in self.texts.items()}, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.ranks is not None:
            try:
                return self.ranks.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            except ValueError:  # runs of white space beyond its stack
                pass
        return np.array(self.own.encode(text, add_special_tokens=False).ids, np.int64)


class Pieces:
    """Encodes by a piece model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        name = self.model.id_to_piece
        self.texts = {i: bytes([int(name(i)[3:5], 16)]) if self.model.is_byte(i) else name(i).replace("▁", " ").encode() for i in range(self.size)}

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int64)


class Words:
    """Token texts by id, looked up for whole arrays."""

    def __init__(self, texts: dict[int, bytes], size: int):
        self.lengths = np.array([len(texts.get(i, b"")) for i in range(size)], np.int64)
        self.array = pa.array([texts.get(i, b"") for i in range(size)], pa.large_binary())

    def joined(self, ids: np.ndarray) -> np.ndarray:
        _, offsets, data = self.array.take(pa.array(ids)).buffers()
        return np.frombuffer(data, np.uint8)[: np.frombuffer(offsets, np.int64)[len(ids)]] if len(ids) else np.zeros(0, np.uint8)


class Aligner:
    """The groups and links of texts."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.one, self.two = Words(a.texts, a.size), Words(b.texts, b.size)
        marked = [f"{i}{end}".encode() for ends, size in ((",|", a.size), (",;", b.size)) for end in ends for i in range(size)]
        self.written = pa.array(marked, pa.large_binary())

    def _valid(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """The ids of A and of B for each text, none where either does not give the space and the text."""
        none = np.zeros(0, np.int64)
        lists_a, lists_b = [], []
        for text in texts:
            x, y = (self.a.encode(" " + text), self.b.encode(text)) if text else (none, none)
            if len(x):
                whole = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass"), np.uint8)
                if not (np.array_equal(self.one.joined(x), whole) and np.array_equal(self.two.joined(y), whole)):
                    x = y = none
            lists_a.append(x)
            lists_b.append(y if len(x) else none)
        return lists_a, lists_b, np.array([len(x) for x in lists_a], np.int64)

    def align(self, texts: list[str]) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of each text, its groups' digest; and for its distinct id pairs: the text's place, the pair (A's id times 2^32
        and B's), and how many links it has."""
        lists_a, lists_b, n_a = self._valid(texts)
        n_b = np.array([len(y) for y in lists_b], np.int64)
        x, y = (np.concatenate([*lists, np.zeros(0, np.int64)]) for lists in (lists_a, lists_b))
        ends_a, ends_b = np.cumsum(self.one.lengths[x]), np.cumsum(self.two.lengths[y])
        # Texts have equal bytes in both, so ends of all texts can be compared, and every text ends a group.
        at = np.searchsorted(ends_b, ends_a)
        meets = ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a if len(x) else np.zeros(0, bool)
        group_a = np.append(0, np.cumsum(meets)[:-1]) if len(x) else x
        group_b = np.searchsorted(ends_a[meets], ends_b)
        groups = int(meets.sum())
        size_a, size_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        text_of = np.repeat(np.arange(len(texts)), n_a)[meets]
        count = lambda w=None: np.bincount(text_of, w, minlength=len(texts)).astype(np.int64)
        numbers = {"n_a": n_a, "n_b": n_b, "n_groups": count(), "n_links": self._sums(text_of, size_a * size_b, len(texts))}
        digests = self._digests(x, y, group_a, group_b, size_a, size_b, n_a + n_b)
        return numbers, digests, *self._pairs(x, y, group_a, group_b, size_a, size_b, text_of)

    @staticmethod
    def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """Exact sums of values by owner (sorted)."""
        total = np.append(0, np.cumsum(values))
        return total[np.searchsorted(owner, np.arange(n), "right")] - total[np.searchsorted(owner, np.arange(n), "left")]

    def _digests(self, x, y, group_a, group_b, size_a, size_b, tokens: np.ndarray) -> list[str]:
        before_b, upto_a = np.cumsum(size_b) - size_b, np.cumsum(size_a)
        place_a, place_b = np.arange(len(x)) + before_b[group_a], np.arange(len(y)) + upto_a[group_b]
        last = lambda g: np.append(g[1:] != g[:-1], True).astype(np.int64) if len(g) else g
        line = np.empty(len(x) + len(y), np.int64)
        line[place_a] = last(group_a) * self.a.size + x
        line[place_b] = 2 * self.a.size + last(group_b) * self.b.size + y
        taken = self.written.take(pa.array(line))
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(line) + 1] if len(line) else np.zeros(1, np.int64)
        data = memoryview(taken.buffers()[2]) if len(line) else b""
        edges = offsets[np.append(0, np.cumsum(tokens))].tolist()
        return [hashlib.sha256(data[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(edges[:-1], edges[1:], strict=True)]

    def _pairs(self, x, y, group_a, group_b, size_a, size_b, text_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        times_a, times_b = np.ones(len(x), np.int64), np.ones(len(y), np.int64)
        large = size_a * size_b > LARGE
        if large.any():  # each id once, with its times
            x, group_a, times_a = self._distinct(x, group_a, large)
            y, group_b, times_b = self._distinct(y, group_b, large)
        first = np.searchsorted(group_b, np.arange(len(size_b)))
        n = np.diff(np.append(first, len(y)))
        rep = n[group_a]
        ends = np.cumsum(rep)
        j = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - rep, rep) + np.repeat(first[group_a], rep)
        pair, text = np.repeat(x << 32, rep) | y[j], np.repeat(text_of[group_a], rep)
        times = np.repeat(times_a, rep) * times_b[j]
        order = np.lexsort((pair, text))
        pair, text, times = pair[order], text[order], times[order]
        head = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (text[1:] != text[:-1]))) if len(pair) else np.zeros(0, np.int64)
        return text[head], pair[head], np.add.reduceat(times, head) if len(head) else times

    @staticmethod
    def _distinct(ids: np.ndarray, group: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = large[group]
        codes, times = np.unique(group[some] << 32 | ids[some], return_counts=True)
        ids, group = np.append(ids[~some], codes & 0xFFFFFFFF), np.append(group[~some], codes >> 32)
        order = np.argsort(group, kind="stable")
        return ids[order], group[order], np.append(np.ones(int((~some).sum()), np.int64), times)[order]


_ROW = np.dtype([("doc_id", "<i8"), ("null", "?"), ("n_a", "<i8"), ("n_b", "<i8"), ("n_groups", "<i8"), ("n_links", "<i8"), ("pairs", "<i8")])
_SLICES = "slice bigint, rows binary, digests array<string>, pairs array<bigint>, held array<int>, places binary, times binary"
_aligners: dict[tuple[str, str, str], Aligner] = {}


def aligned_slices(documents: DataFrame, vocabulary: str, pieces: str, pattern: str) -> DataFrame:
    """(doc_id, text) -> a row for each slice of texts: its documents' numbers, its distinct id pairs and in how many of its
    documents each is linked, and for every document the places of its pairs among these and their links."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = (vocabulary, pieces, pattern)
        if key not in _aligners:
            _aligners[key] = Aligner(ByteLevel(vocabulary, pattern), Pieces(pieces))
        held: list[tuple] = []
        size, made = 0, TaskContext.get().partitionId() << 32

        def flush() -> pd.DataFrame:
            nonlocal size, made
            rows, digests, pairs, times = (np.concatenate([h[0] for h in held]), sum((h[1] for h in held), []), np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]))
            distinct, place = np.unique(pairs, return_inverse=True)
            out = pd.DataFrame({"slice": [made], "rows": [rows.tobytes()], "digests": [digests], "pairs": [distinct], "held": [np.bincount(place, minlength=len(distinct)).astype(np.int32)], "places": [place.astype(np.int32).tobytes()], "times": [times.tobytes()]})
            held.clear()
            size, made = 0, made + 1
            return out

        for frame in frames:
            texts = [t or "" for t in frame["text"].tolist()]
            ends = np.cumsum([len(t) for t in texts])
            first = 0
            while first < len(texts):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PIECE, "right")))
                numbers, digests, text, pair, times = _aligners[key].align(texts[first:last])
                rows = np.zeros(last - first, _ROW)
                rows["doc_id"], rows["null"] = frame["doc_id"].to_numpy()[first:last], frame["null"].to_numpy()[first:last]
                for name, values in numbers.items():
                    rows[name] = values
                rows["pairs"] = np.bincount(text, minlength=last - first)
                held.append((rows, digests, pair, times))
                size += int(ends[last - 1] - (ends[first - 1] if first else 0))
                first = last
                if size >= SLICE:
                    yield flush()
        if held:
            yield flush()

    id_ = F.col("doc_id").cast("long")
    plain = documents.select(F.coalesce(id_, F.lit(0)).alias("doc_id"), id_.isNull().alias("null"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return common.stash(plain.mapInPandas(run, _SLICES), "alignment-slices")


def align(documents: DataFrame, vocabulary: str, pieces: str, pattern: str) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, n_a, n_b, n_groups, n_links, n_best, n_best_b, count_sum, groups_sha256: a row for
    each row. vocabulary, pieces: the files of the tokenizers A and B; pattern: A's split of texts into words."""
    slices = aligned_slices(documents, vocabulary, pieces, pattern)
    asked = slices.select("slice", F.posexplode(F.arrays_zip("pairs", "held")).alias("k", "p")).select("slice", "k", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held"))
    counts = common.stash(asked.groupBy("pair").agg(F.sum("held").alias("count")).select("pair", "count", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")), "alignment-counts")
    best_a, best_b = (counts.groupBy(c).agg(F.max("count").alias(f"most_{c}")) for c in ("a", "b"))  # a row for each id of a vocabulary
    ranked = counts.join(best_a, "a").join(best_b, "b").select("pair", "count", (F.col("count") == F.col("most_a")).alias("best_a"), (F.col("count") == F.col("most_b")).alias("best_b"))
    found = asked.drop("held").join(ranked, "pair").groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("k", "count", "best_a", "best_b"))).alias("found"))  # a slice's distinct pairs
    both = slices.select("slice", "rows", "digests", "places", "times").join(found, "slice", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i]  # noqa: B023, E731
                rows, places, times = np.frombuffer(get("rows").as_py(), _ROW), np.frombuffer(get("places").as_py(), np.int32), np.frombuffer(get("times").as_py(), np.int64)
                values = get("found").values
                ends = np.append(0, np.cumsum(rows["pairs"]))

                def total(weight: np.ndarray) -> pa.Array:
                    return pa.array(np.diff(np.append(0, np.cumsum(times * weight))[ends]))  # noqa: B023

                part = (lambda c: values.field(c).to_numpy(zero_copy_only=False).astype(np.int64)[places]) if values is not None else (lambda c: places.astype(np.int64))  # noqa: B023
                columns = [pa.array(rows["doc_id"], mask=rows["null"]), *(pa.array(np.ascontiguousarray(rows[c])) for c in ("n_a", "n_b", "n_groups", "n_links")), total(part("best_a")), total(part("best_b")), total(part("count")), pa.array(get("digests").as_py(), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "n_best_b", "count_sum", "groups_sha256"])

    return common.map_batches(both, run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, n_best_b bigint, count_sum bigint, groups_sha256 string")
