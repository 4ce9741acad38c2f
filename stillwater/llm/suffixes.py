"""Removal of repeated passages with suffix arrays by linear grouping.

Every repeated string of `least` bytes is found where it starts. Windows of that length are dealt by content: a window's key is
the least hash among its substrings of GRAM bytes, so equal windows have equal keys wherever they stand, and neighbouring
windows mostly share one; a run of windows with one key is a segment. Segments, named by digests, are first put together
within their task, then by key: a segment whose bytes occurred before is repeated as a whole, and a key with one occurrence
is done. Of keys with several different segments the texts of the first occurrences are fetched, and suffix arrays over them
tell which windows are equal; the earliest of these stays and the others go.

The suffix arrays are built by grouping (Baier 2016): suffixes are put in groups by their Lyndon prefixes, groups are taken in
descending order, each gives its context to the previous smaller suffixes of its members, which splits their groups, and then
the groups are taken in ascending order and each one's order is that of the suffixes behind its members' prefixes: nothing
is renamed or solved recursively. Many small arrays, one for each key, advance together, a group of each at a time.
A key with very many different segments is dealt in parts; equal windows of different parts meet by their digests.

Documents are ordered by id, a null id after all others; rows that share an id are ordered by a hash of their texts, and
equal rows are one document, so each gets the same result. A null text is empty; a text shorter than `least` loses nothing.
Repeated rows, ties and empty tables need nothing else; other columns are not read. Segments are told apart by 128 bits, 64
of their key and 64 of their digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillwater.llm import common

#: Bytes of the substrings whose hashes name windows, a power of 2.
GRAM = 32
#: Distinct segments that one suffix array takes of a key, in the mean.
PART = 2_048
#: Bytes of segments that a task puts in order together.
CHUNK = 3_000_000

_RADIX = 0x9E3779B97F4A7C15
_INVERSE = pow(_RADIX, -1, 1 << 64)


# --------------------------------------------------------------------------- suffix arrays


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), then those of first[1], and so on."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(first, count)


class Grouping:
    """The suffixes of many texts in groups. A text is the bytes begin[i]:begin[i + 1] of data, each of its strings ended by a 0,
    which no string holds. place: each suffix's slot, group: its group's first slot, length: that of its Lyndon prefix so far."""

    def __init__(self, data: np.ndarray, begin: np.ndarray):
        n = len(data)
        self.data, self.begin, self.n = np.append(data, 0), begin, n
        text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        key = text * 257 + data
        self.order = np.argsort(key, kind="stable")
        sorted_ = key[self.order]
        first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if n else np.zeros(0, np.int64)
        self.size = np.zeros(n + 1, np.int64)
        self.size[first] = np.diff(np.append(first, n))
        self.group, self.place = np.full(n + 1, -1, np.int64), np.empty(n, np.int64)  # what stands before the first suffix is below all
        self.group[self.order] = np.repeat(first, self.size[first])
        self.place[self.order] = np.arange(n)
        self.length = np.ones(n, np.int64)
        self.before = np.full(n, -1, np.int64)  # the previous smaller suffix, of suffixes of groups that were taken

    def refine(self) -> None:
        """Takes each text's groups in descending order until its ends are left."""
        at = self.begin[1:] - 1
        low = self.begin[:-1]
        while True:
            first = self.group[self.order[at]]
            going = first > low  # the lowest group holds the ends
            if not going.all():
                at, low, first = at[going], low[going], first[going]
            if not len(at):
                return
            self._give(first)
            at = first - 1

    def _give(self, first: np.ndarray) -> None:
        size = self.size[first]
        members = self.order[_ranges(first, size)]
        mine = np.repeat(first, size)
        # Previous smaller: back over suffixes of this group and, by their own pointers, of those taken before.
        p = members - 1
        open_ = np.flatnonzero(self.group[p] >= mine)
        while len(open_):
            x = p[open_]
            p[open_] = np.where(self.group[x] > mine[open_], self.before[x], x - 1)
            open_ = open_[self.group[p[open_]] >= mine[open_]]
        self.before[members] = p
        real = self.data[p] > 0  # an end is not extended
        if not real.all():
            p, members = p[real], members[real]
        if not len(p):
            return
        # How often this group's prefix follows each of them.
        by = np.argsort(p, kind="stable")
        p, members = p[by], members[by]
        one = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        times = np.diff(np.append(one, len(p)))
        p, members = p[one], members[one]
        self.length[p] += times * self.length[members]
        # They go to the end of their groups, those it follows oftenest last.
        home = self.group[p]
        by = np.lexsort((times, home))
        p, home, times = p[by], home[by], times[by]
        new = np.append(True, home[1:] != home[:-1])
        head = np.flatnonzero(new)
        moved = np.diff(np.append(head, len(p)))
        homes = home[head]
        tail = homes + self.size[homes] - moved
        slots = _ranges(tail, moved)
        old = self.place[p]
        owner = np.repeat(np.arange(len(homes)), moved)
        outside = old < tail[owner]  # these leave slots that others, now standing in the tail, take
        if outside.any():
            standing = self.order[slots]
            marks = np.sort(p)
            hit = np.searchsorted(marks, standing)
            stays = (hit < len(marks)) & (marks[np.minimum(hit, len(marks) - 1)] == standing)
            gone = standing[~stays]
            free = old[outside]
            free = free[np.lexsort((free, owner[outside]))]
            self.order[free], self.place[gone] = gone, free
        self.order[slots], self.place[p] = p, slots
        # New groups, by times within a home.
        part = np.flatnonzero(new | np.append(True, times[1:] != times[:-1]))
        counts = np.diff(np.append(part, len(p)))
        start = slots[part]
        self.size[homes] -= moved
        self.size[start] = counts
        self.group[p] = np.repeat(start, counts)

    def emit(self) -> np.ndarray:
        """The suffix arrays, text after text: groups in ascending order, each by the ranks of the suffixes behind its members'
        prefixes. Suffixes equal up to their ends come in any order."""
        rank = np.full(self.n + 1, -1, np.int64)
        at, stop = self.begin[:-1], self.begin[1:]
        kept = at < stop
        at, stop = at[kept], stop[kept]
        ends = True
        while len(at):
            size = self.size[at]
            members = self.order[_ranges(at, size)]
            free = at.copy()  # the next slot of each group
            owner = np.repeat(np.arange(len(at)), size)
            if ends:  # the lowest groups
                rank[members] = self.place[members]
            else:
                behind = members + self.length[members]
                while len(members):
                    ready = rank[behind] >= 0
                    now, own = members[ready], owner[ready]
                    by = np.lexsort((rank[behind[ready]], own))
                    now, own = now[by], own[by]
                    counts = np.bincount(own, minlength=len(at))
                    slots = _ranges(free, counts)
                    rank[now] = slots
                    self.order[slots] = now
                    free += counts
                    members, behind, owner = members[~ready], behind[~ready], owner[~ready]
            ends = False
            at = at + size
            kept = at < stop
            at, stop = at[kept], stop[kept]
        return self.order


def suffix_arrays(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """data: uint8 or wider; texts begin[i]:begin[i + 1] whose strings end with 0, which they do not hold. The order of each
    text's suffixes, by absolute place, text after text; suffixes are compared up to their string's end."""
    g = Grouping(data, np.asarray(begin, np.int64))
    g.refine()
    return g.emit()


# --------------------------------------------------------------------------- windows and segments


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each GRAM bytes, by doubling."""
    h, width = common._BYTE[data], 1
    while width < GRAM and len(h) > width:
        h = common.mix(h[:-width] * np.uint64(_RADIX) + h[width:])
        width *= 2
    return h if width == GRAM else h[:0]


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    have = 1
    while have < width and len(h):
        step = min(have, width - have)
        h = np.minimum(h[:-step], h[step:]) if len(h) > step else h[:0]
        have += step
    return h


def segments(data: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The segments of the texts, text after text: number of the text, first byte (in data), windows, key, digest, and whether
    windows of it may be equal to each other. A segment has at most least - GRAM + 1 windows, so the segments of a long run of
    one key are equal if their bytes are."""
    most = least - GRAM + 1
    h = _gram_hashes(data)
    key = _least(h, most)
    n = len(key)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    real = np.zeros(n + 1, np.int64)  # whether a window lies in one text
    lengths = np.diff(at)
    some = lengths >= least
    np.add.at(real, at[:-1][some], 1)
    np.add.at(real, at[:-1][some] + lengths[some] - least + 1, -1)
    real = np.cumsum(real[:-1]) > 0
    cut = np.empty(n, bool)
    cut[0], cut[1:] = True, (key[1:] != key[:-1]) | (real[1:] != real[:-1])
    cut[at[:-1][at[:-1] < n]] = True
    first = np.flatnonzero(cut)
    count = np.diff(np.append(first, n))
    first, count = first[real[first]], count[real[first]]
    pieces = -(-count // most)
    owner = np.repeat(np.arange(len(first)), pieces)
    begin = _ranges(np.zeros(len(first), np.int64), pieces) * most
    first, count = first[owner] + begin, np.minimum(most, count[owner] - begin)
    # Digests by prefix sums of a polynomial; the radix is odd, so its powers can be divided by.
    powers = np.full(len(data) + 1, _RADIX, np.uint64)
    powers[0] = 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(common._BYTE[data] * np.multiply.accumulate(powers)[:-1], out=sums[1:])
    powers[1:] = _INVERSE
    ends = first + count + least - 1
    digest = common.mix((sums[ends] - sums[first]) * np.multiply.accumulate(powers)[first] + count.astype(np.uint64))
    # Equal windows of a segment make its bytes periodic there, and all of its windows hold the gram at the last one's start.
    ahead = np.lib.stride_tricks.sliding_window_view(h, most)
    periodic = np.zeros(len(first), bool)
    for k in range(0, len(first), 16_384):
        near = ahead[(first + count - 1)[k : k + 16_384]]
        periodic[k : k + 16_384] = (near[:, 1:] == near[:, :1]).any(1)
    return np.searchsorted(at, first, "right") - 1, first, count, key[first], digest, periodic


_PLACES = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("start", "<i4")])
_FOUND = "key bigint, digest bigint, doc bigint, tie bigint, start int, windows int, periodic boolean, n int, others binary"


def found_segments(documents: DataFrame, least: int) -> DataFrame:
    """(doc, tie, text) -> for each distinct segment of some 8 MB of text: its first place, and the other ones as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text", 8_000_000):
            data, at = common.text_bytes(part.column("text"))
            row, first, windows, key, digest, periodic = segments(data, at, least)
            if not len(row):
                continue
            place = np.empty(len(row), _PLACES)
            place["doc"], place["tie"] = part.column("doc").to_numpy()[row], part.column("tie").to_numpy()[row]
            place["start"] = first - at[row]
            order = np.lexsort((place["start"], place["tie"], place["doc"], digest, key))
            place, key, digest, windows, periodic = place[order], key[order], digest[order], windows[order], periodic[order]
            head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])))
            n = np.diff(np.append(head, len(key)))
            others = np.delete(place, head).tobytes()
            offsets = np.append(0, np.cumsum(n - 1)).astype(np.int32) * _PLACES.itemsize
            columns = [key[head].view(np.int64), digest[head].view(np.int64), place["doc"][head].copy(), place["tie"][head].copy(), place["start"][head].copy(), windows[head].astype(np.int32), periodic[head], n.astype(np.int32)]
            packed = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(offsets), pa.py_buffer(others)])
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), packed], names=["key", "digest", "doc", "tie", "start", "windows", "periodic", "n", "others"])

    return common.map_batches(documents, run, _FOUND)


def shared_segments(found: DataFrame) -> DataFrame:
    """found_segments() of keys that occur more than once, and periodic ones, each with the first place of its bytes in the
    whole corpus (f_doc, f_tie, f_start), whether its windows must be compared, and in how many parts its key is dealt."""
    key, same = Window.partitionBy("key"), Window.partitionBy("key", "digest")
    held = found.withColumn("total", F.sum("n").over(key)).where("total > 1 or periodic")
    held = held.withColumn("several", F.col("periodic") | (F.min("digest").over(key) != F.max("digest").over(key)))
    held = held.withColumn("parts", F.ceil(F.count("*").over(key) / PART).cast("int"))
    held = held.withColumn("f", F.min(F.struct("doc", "tie", "start")).over(same))
    return held.select("key", "digest", "doc", "tie", "start", "windows", "n", "others", "several", "parts", F.col("f.doc").alias("f_doc"), F.col("f.tie").alias("f_tie"), F.col("f.start").alias("f_start"))


_SPAN = "doc bigint, tie bigint, begin int, stop int"


def repeated_segments(shared: DataFrame, least: int) -> DataFrame:
    """The spans of segments whose bytes occurred before: doc, tie, begin, stop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(c).to_numpy()  # noqa: B023, E731
            n = get("n").astype(np.int64)
            others = np.frombuffer(b"".join(batch.column("others").to_pylist()), _PLACES)
            place = np.empty(batch.num_rows, _PLACES)
            place["doc"], place["tie"], place["start"] = get("doc"), get("tie"), get("start")
            again = (get("doc") != get("f_doc")) | (get("tie") != get("f_tie")) | (get("start") != get("f_start"))
            row = np.repeat(np.arange(batch.num_rows), n - 1)
            # The first place may be one of the others' only if a copy of the row is the first.
            first = (others["doc"] == get("f_doc")[row]) & (others["tie"] == get("f_tie")[row]) & (others["start"] == get("f_start")[row])
            place = np.concatenate([place[again], others[~first]])
            windows = get("windows")
            stop = place["start"] + np.concatenate([windows[again], windows[row[~first]]]) + least - 1
            yield pa.RecordBatch.from_arrays([pa.array(place["doc"].copy()), pa.array(place["tie"].copy()), pa.array(place["start"].copy()), pa.array(stop.astype(np.int32))], names=["doc", "tie", "begin", "stop"])

    return common.map_batches(shared.select("doc", "tie", "start", "windows", "n", "others", "f_doc", "f_tie", "f_start"), run, _SPAN)


def fetched(texts: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """wanted (key, part, parts, doc, tie, start, windows) -> the same with the segments' bytes."""
    asked = wanted.groupBy("doc", "tie").agg(F.collect_list(F.struct("key", "part", "parts", "start", "windows")).alias("asked"))  # at most a document's segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text", 8_000_000):
            data, at = common.text_bytes(part.column("text"))
            lists = part.column("asked")
            rows = lists.flatten()
            owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
            get = lambda c: rows.field(c).to_numpy()  # noqa: B023, E731
            length = get("windows").astype(np.int64) + least - 1
            flat = data[_ranges(at[owner] + get("start"), length)]
            offsets = np.append(0, np.cumsum(length)).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            columns = [rows.field("key"), rows.field("part"), rows.field("parts"), part.column("doc").take(pa.array(owner)), part.column("tie").take(pa.array(owner)), rows.field("start"), packed]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "part", "parts", "doc", "tie", "start", "bytes"])

    met = texts.join(asked, ["doc", "tie"]).select("doc", "tie", "text", "asked")
    return common.map_batches(met, run, "key bigint, part int, parts int, doc bigint, tie bigint, start int, bytes binary")


def _meeting(text: np.ndarray, key: np.ndarray, raw: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """Whether each segment (raw[at[i]:at[i + 1]], of a text's key) may have a window that is equal to another of its text. Equal
    windows have the gram of the key at one place; by that place, in four classes, they agree at least in some bytes on either
    side of it. A segment whose grams have no such bytes twice in its text has no equal windows."""
    owner = np.repeat(np.arange(len(key)), np.diff(at))
    h = _gram_hashes(raw)
    p = np.flatnonzero(h == key[owner[: len(h)]])
    p = p[p + GRAM <= at[1:][owner[p]]]
    owner = owner[p]
    powers = np.full(len(raw) + 1, _RADIX, np.uint64)
    powers[0] = 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(common._BYTE[raw] * np.multiply.accumulate(powers)[:-1], out=sums[1:])
    powers[1:] = _INVERSE
    powers = np.multiply.accumulate(powers)
    found = np.zeros(len(key), bool)
    edges = np.arange(5) * (least - GRAM + 1) // 4
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        a, b = p - low, p + least - high + 1
        inside = (a >= at[:-1][owner]) & (b <= at[1:][owner])
        a, b, mine = a[inside], b[inside], owner[inside]
        value = common.mix((sums[b] - sums[a]) * powers[a]) + common.mix(text[mine].astype(np.uint64))
        _, one, times = np.unique(value, return_inverse=True, return_counts=True)
        found[mine[times[one] > 1]] = True
    return found


def _compared(table: pa.Table, least: int) -> pa.Table:
    """Rows of fetched(), sorted by key and part -> the spans of windows that have an earlier equal one in their array; for each
    first window of a key in parts: two digests and its span."""
    table = table.combine_chunks()
    get = lambda c: table.column(c).to_numpy()
    key, part, parts, doc, tie, start = (get(c) for c in ("key", "part", "parts", "doc", "tie", "start"))
    column = table.column("bytes").combine_chunks()
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    # Segments without equal windows need no array; those of a key in parts are told to the other parts.
    text = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]))[: len(key)])
    kept = (parts > 1) | _meeting(text, key.view(np.uint64), raw, at, least)
    if not kept.all():
        raw = raw[np.repeat(kept, np.diff(at))]
        at = np.append(0, np.cumsum(np.diff(at)[kept]))
        key, part, parts, doc, tie, start = (c[kept] for c in (key, part, parts, doc, tie, start))
    # Each segment ends with a 0: bytes are raised by 1.
    n, length = len(key), np.diff(at)
    data = np.zeros(len(raw) + n, np.int64)
    begin = at[:-1] + np.arange(n)
    data[_ranges(begin, length)] = raw.astype(np.int64) + 1
    texts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]))[:n])
    order = suffix_arrays(data, np.append(begin[texts], len(data)))
    # Suffixes with equal first `least` bytes stand together: windows that are equal to the one before.
    segment = np.repeat(np.arange(n), length + 1)
    left = (begin + length)[segment] - np.arange(len(data))
    order = order[left[order] >= least]
    text = np.repeat(np.arange(len(texts)), np.diff(np.append(texts, n)))[segment[order]]
    same = np.zeros(len(order), bool)
    # Byte after byte, as far as pairs still agree.
    pair = np.flatnonzero(text[1:] == text[:-1]) + 1
    for step in range(least):
        pair = pair[data[order[pair] + step] == data[order[pair - 1] + step]]
        if not len(pair):
            break
    same[pair] = True
    group = np.cumsum(~same) - 1
    s = segment[order]
    place = start[s] + order - begin[s]
    by = np.lexsort((place, tie[s], doc[s], group))
    first = np.append(True, group[by][1:] != group[by][:-1]) if len(by) else np.zeros(0, bool)
    open_ = by[first & (parts[s[by]] > 1)]
    # Windows that go, as runs of one segment: a row for each run.
    again = by[~first]
    again = again[np.argsort(order[again])]
    run = np.flatnonzero(np.append(True, (np.diff(order[again]) != 1) | (np.diff(s[again]) != 0))) if len(again) else again
    longer = np.diff(np.append(run, len(again))) - 1
    again = again[run]
    digests = [hashlib.blake2b(data[o : o + least].astype(np.uint8).tobytes(), digest_size=16).digest() for o in order[open_].tolist()]
    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    rows = np.concatenate([again, open_])
    longer = np.append(longer, np.zeros(len(open_), np.int64))
    blank = np.zeros(len(again), np.int64)
    return pa.table({
        "again": pa.array(np.arange(len(rows)) < len(again)), "one": pa.array(np.concatenate([blank, halves[:, 0]])), "two": pa.array(np.concatenate([blank, halves[:, 1]])),
        "doc": pa.array(doc[s[rows]]), "tie": pa.array(tie[s[rows]]), "begin": pa.array(place[rows].astype(np.int32)), "stop": pa.array((place[rows] + longer + least).astype(np.int32)),
    })


def compared(segments_: DataFrame, least: int) -> DataFrame:
    """fetched() -> again (whether the span goes), one, two (digests of windows that meet other parts), doc, tie, begin, stop."""
    dealt = segments_.repartition("key", "part").sortWithinPartitions("key", "part", "doc", "tie", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        rows = CHUNK // 8 // (2 * least)
        for batch in (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows)):
            if size >= CHUNK:  # at the first key after so many bytes
                last = held[-1].slice(held[-1].num_rows - 1)
                here = (batch.column("key").to_numpy() != last.column("key")[0].as_py()) | (batch.column("part").to_numpy() != last.column("part")[0].as_py())
                if here.any():
                    cut = int(np.argmax(here))
                    held.append(batch.slice(0, cut))
                    yield from _compared(pa.Table.from_batches(held), least).to_batches()
                    held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.column("bytes").nbytes
        if held:
            yield from _compared(pa.Table.from_batches(held), least).to_batches()

    return common.map_batches(dealt, run, f"again boolean, one bigint, two bigint, {_SPAN}")


# --------------------------------------------------------------------------- removal


def identified(documents: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, doc (a null id counts as the greatest), tie (0, or a hash of the text where ids repeat), text."""
    repeats = not documents.groupBy("doc_id").count().where("count > 1").isEmpty()
    tie = F.xxhash64("text") if repeats else F.lit(0).cast("long")
    return documents.select("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), tie.alias("tie"), F.coalesce("text", F.lit("")).alias("text"))


def repeated_spans(texts: DataFrame, least: int = 100) -> DataFrame:
    """identified() -> doc, tie, begin, stop: spans (of bytes) of repeated strings of at least `least` bytes, which may overlap."""
    source = texts.where(F.octet_length("text") >= least).select("doc", "tie", "text")
    shared = common.stash(shared_segments(found_segments(source, least)), "suffixes-shared")
    whole = repeated_segments(shared, least)
    here = (F.col("doc") == F.col("f_doc")) & (F.col("tie") == F.col("f_tie")) & (F.col("start") == F.col("f_start"))
    wanted = shared.where(F.col("several") & here).select("key", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int").alias("part"), "parts", "doc", "tie", "start", "windows").distinct()
    windows = common.stash(compared(fetched(source, wanted, least).dropDuplicates(["key", "part", "doc", "tie", "start"]), least), "suffixes-windows")
    # Equal windows of different parts of a key.
    open_ = windows.where(~F.col("again"))
    firsts = open_.groupBy("one", "two").agg(F.min(F.struct("doc", "tie", "begin")).alias("f"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = open_.join(firsts, ["one", "two"]).where(F.struct("doc", "tie", "begin") != F.col("f"))
    columns = ["doc", "tie", "begin", "stop"]
    return whole.unionByName(windows.where("again").select(*columns)).unionByName(met.select(*columns))


def remove_repeats(documents: DataFrame, least: int = 100, keep_text: bool = False) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, binary, with keep_text): a
    row for each row. Every byte goes that is covered by a string of `least` bytes that also starts earlier."""
    if least < 2 * GRAM:
        raise ValueError(f"strings of fewer than {2 * GRAM} bytes are not supported")
    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = common.bucketed(identified(plain), ["doc", "tie"], buckets, "suffixes-texts")
    spans = repeated_spans(texts, least).groupBy("doc", "tie").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))  # a document's own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text", 8_000_000):
            data, at = common.text_bytes(part.column("text"))
            lists = part.column("spans")
            sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            rows = lists.flatten()
            owner = np.repeat(np.arange(part.num_rows), sizes)
            change = np.zeros(len(data) + 1, np.int64)
            np.add.at(change, at[owner] + rows.field("begin").to_numpy(), 1)
            np.add.at(change, at[owner] + rows.field("stop").to_numpy(), -1)
            gone = np.cumsum(change[:-1]) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            edge = at[:-1][at[:-1] < len(data)]
            begins[edge] = gone[edge]
            total = lambda flags: np.diff(np.append(0, np.cumsum(flags))[at])
            kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            columns = [part.column("doc_id"), pa.array(np.diff(at)), pa.array(total(gone)), pa.array(total(begins)), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = texts.join(spans, ["doc", "tie"], "left").select("doc_id", "text", "spans")
    return common.map_batches(joined, run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text)
