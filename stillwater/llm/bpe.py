"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task gathers the distinct words of many documents into one flat array of symbols. An inverted index from
token pair (named by the rank of the token that the pair forms) to symbol positions drives the encoder: ranks
are taken in order from a heap, each one merges all its positions in the whole word list at once, and only the
pairs left and right of a merge are looked up again and posted. Documents are then put together from their
words' ids, so a word is encoded once however often it occurs. Nothing is shuffled: each task replays the
merges for the words of its own rows, and the memory it uses is bounded by two parameters.

Defined cases: a null text is the empty text; an empty text has no ids; rows may repeat, ids may be null, and
each row is encoded for itself; an empty table gives an empty table; all input columns may have any names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stillwater.llm import common

NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks in a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Encodes lists of words by the ranks; exactly the ids that merging each word's lowest pair, leftmost first, gives."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.texts: list[bytes] = [b""] * self.size
        pairs: dict[int, int] = {}
        base = self.base = self.size + 1  # the last symbol, self.size, stands for "no symbol" and pairs with nothing
        risky = np.zeros(self.size + 1, bool)
        for token, rank in ranks.items():
            self.texts[rank] = token
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * base + right] = rank
                # A token that lies inside another of lower rank: its merges can open a pair that must go first.
                for part in (left, right):
                    if part is not None and part > rank:
                        risky[part] = True
        self.risky = risky
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(2**62))
        self.values = np.append(np.fromiter(pairs.values(), np.int32, len(pairs))[order], NONE)
        self.byte_ids = np.array([ranks.get(bytes([b]), self.size) for b in range(256)], np.int32)
        self.doubled = {r for k, r in pairs.items() if k // base == k % base}

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, word after word, and the number of ids of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), lengths
        begins = np.cumsum(lengths) - lengths
        real = begins[lengths > 0]
        symbol = np.append(self.byte_ids[data], np.int32(self.size))
        after = np.arange(1, n + 2, dtype=np.int32)
        before = np.arange(-1, n, dtype=np.int32)
        before[real] = n
        after[np.append(real[1:], n) - 1] = n
        after[n] = before[n] = n
        alive = np.ones(n, bool)
        rank = np.append(self._ranks_of(symbol[:n], symbol[after[:n]]), NONE)

        index: dict[int, list[np.ndarray]] = {}

        def post(positions: np.ndarray, ranks: np.ndarray) -> list[int]:
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            new = []
            for r, p in zip(ranks[np.append(0, cuts)].tolist(), np.split(positions, cuts), strict=True):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    new.append(r)
            return new

        some = np.flatnonzero(rank[:n] != NONE).astype(np.int32)
        if not len(some):
            return symbol[:n], lengths
        heap = post(some, rank[some])
        heapify(heap)
        while heap:
            r = heappop(heap)
            lists = index.pop(r)
            p = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            p = p[rank[p] == r]  # others have been merged meanwhile
            if not len(p):
                continue
            if self.risky[r]:  # only the first in each word, so that a lower pair that this opens goes next
                word = np.searchsorted(real, p, "right")
                first = np.append(True, word[1:] != word[:-1])
                if not first.all():
                    index[r] = [p[~first]]
                    heappush(heap, r)
                p = p[first]
            elif r in self.doubled and len(p) > 1:  # in a run of equal symbols every other pair
                joined = after[p[:-1]] == p[1:]
                starts = np.append(0, np.flatnonzero(~joined) + 1)
                place = np.arange(len(p)) - np.repeat(starts, np.diff(np.append(starts, len(p))))
                # two symbols that form a token need not be equal, though its rank has an equal pair too
                same = symbol[p] == symbol[after[p]]
                p = p[(place % 2 == 0) | ~same]
            gone = after[p]
            right = after[gone]
            symbol[p] = r
            after[p] = right
            before[right] = p
            before[n] = n
            alive[gone] = False
            rank[gone] = NONE
            left = before[p]
            touched = np.concatenate([p, left[left != n]])
            new = self._ranks_of(symbol[touched], symbol[after[touched]])
            rank[touched] = new
            rank[n] = NONE
            keep = new != NONE
            if keep.any():
                for x in post(touched[keep], new[keep]):
                    heappush(heap, x)
        counts = np.zeros(len(words), np.int64)
        counts[lengths > 0] = np.add.reduceat(alive, real, dtype=np.int64)
        return symbol[:n][alive], counts


class Encoder:
    """Splits texts, encodes new words together, and keeps the ids of words in a bounded store."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_words: int = 400_000):
        self.replay = MergeReplay(ranks)
        self.find = regex.compile(pattern).findall
        self.most_words = most_words
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.new: list[str] = []

    def add(self, text: str) -> np.ndarray:
        """The numbers of a text's words; words not met before wait for settle()."""
        number, out = self.number, self.find(text)
        for w in set(out).difference(number) if len(out) > 8 else [x for x in dict.fromkeys(out) if x not in number]:
            number[w] = len(self.ids) + len(self.new)
            self.new.append(w)
        return np.fromiter(map(number.__getitem__, out), np.int32, len(out))

    def settle(self) -> None:
        """Encode the waiting words. A whole word that is itself a token needs no merge."""
        ranks = self.replay.ranks
        raw = [w.encode("utf-8", "surrogatepass") for w in self.new]
        flat, counts = self.replay.encode([b"" if w in ranks else w for w in raw])
        data, ends = flat.astype("<u4").tobytes(), np.cumsum(counts).tolist()
        start = 0
        for w, end in zip(raw, ends, strict=True):
            known = ranks.get(w)
            self.ids.append(data[4 * start : 4 * end] if known is None else known.to_bytes(4, "little"))
            start = end
        self.new = []

    def ids_of(self, numbers: np.ndarray) -> bytes:
        return b"".join(map(self.ids.__getitem__, numbers.tolist()))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.replay.texts.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[str, Encoder] = {}


def encode_documents(
    df: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep_ids: bool = False,
    chunk_bytes: int = 12_000_000, most_words: int = 400_000,
) -> DataFrame:
    """df and the columns n_tokens, ids_sha256, decoded_sha256 (and ids, array<int>, with keep_ids) of its text column.

    Columns of df with one of these names give way. vocabulary: a rank file, read by the driver; its size is
    that of the vocabulary, whatever the data, and it is broadcast. chunk_bytes, most_words: a task holds texts
    of about so many bytes (or one text), and the ids of about so many words.
    """
    added = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
    kept = [c for c in df.columns if c not in added]
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    key = f"{vocabulary}\n{pattern}\n{most_words}"
    source = df.select(*[df[f"`{c}`"] for c in kept])
    place = kept.index(text)
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in source.schema), "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"] + ["ids array<int>"] * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(ranks.value, pattern, most_words)
        encoder = _encoders[key]
        if encoder.new:  # a task that failed midway has left words
            encoder.clear()
        held: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            encoder.settle()
            for batch, numbers in held:
                ids = [encoder.ids_of(x) for x in numbers]
                columns = [
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids]),
                ]
                if keep_ids:
                    columns.append(pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*kept, *added])
            held.clear()
            if len(encoder.ids) > most_words:
                encoder.clear()

        for part in common.slices(batches, text, 2_000_000):
            texts = part.column(place).to_pylist()
            held.append((part, [encoder.add(x or "") for x in texts]))
            size += part.column(place).nbytes
            if size >= chunk_bytes or len(encoder.new) > most_words:
                yield from flush()
                size = 0
        yield from flush()

    return common.map_batches(source, run, schema)
