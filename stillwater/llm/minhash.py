"""MinHash near-duplicates by a signature-coordinate inverted join.

A task reads whole texts, takes each document's set of word shingles and its signature: for every coordinate the
least value of the set under that coordinate's hash. Documents with equal sets form a class, and the class's
smallest id stands for it. A class posts itself under the (coordinate, value) pairs of the first `posted` coordinates.
Two classes that agree in at least `posted_matches` of these are candidates, so of the pairs that a class shares with
any other (counted over all classes) all but the last `posted_matches - 1`, rarest first, are posted: two such prefixes meet.

A posting carries its class's sketch, PLANES bits of each coordinate of the whole signature. Equal coordinates have equal bits, so
two classes whose sketches agree in fewer than `matches` coordinates are no candidates, and no pair of them is ever made. The more
classes there are, the more of them share a rare element by chance; members of short lists (of at most SHORT classes) that agree
with no other member leave the list at once, so what goes on are near copies and long lists.

Posting lists are never expanded into all pairs. Each member is first held against one leader of its lists;
pairs whose sketches agree (the skipped tails with them) are
confirmed on the full sets, and confirmed links are joined into components. A list within one component is done. In the
others, members outside the list's main component are held against leaders of it and of their own. What is still
outside then is held against all members: pair by pair in lists with few outside, and else, for all lists of a main
component together, in blocks: first of sketches, which leave the documents that agree with any, and then of these documents' full
sets, of which a task takes the intersections as a matrix product and names one link for
each component that a document meets. No list, partner or candidate is left out. Lists are dealt by key and salt, about
SALT_ROWS members each.

Defined cases: a null or wordless text has the empty set and links with nothing; a text with fewer words than a
shingle has its whole word sequence as the one shingle; equal sets always link; a null id links with nothing,
its component_id is null and it is kept; rows that share an id are one node, and each is returned; an empty
table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwater.llm import common
from stillwater.operators import graph

COORDINATES, MATCHES, POSTED, POSTED_MATCHES = 64, 35, 32, 13
#: Low bits of each coordinate that a sketch has.
PLANES = 4
SALT_ROWS = 1024
#: Lists of at most so many classes lose the members that agree with no other one.
SHORT = 64
#: Lists with at most so many members outside their main component are finished pair by pair, others in blocks.
FEW = 16
#: Documents on each side of a block, and of a block of sketches.
BLOCK, SKETCH_BLOCK = 256, 1024

_DRAW = np.random.default_rng(7)
_A = _DRAW.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _DRAW.integers(0, 2**63, 256, dtype=np.uint64)


def shingle_hashes(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each shingle of the texts, text after text, and the n + 1 offsets of the texts."""
    starts, _, first = common.words(data, at)
    value = common.word_hashes(data, starts)
    n_words = np.diff(first)
    counts = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    offsets = np.append(0, np.cumsum(counts))
    total = int(offsets[-1])
    place = np.arange(total) - np.repeat(offsets[:-1], counts) + np.repeat(first[:-1], counts)
    words_left = np.repeat(np.minimum(n_words, width), counts)
    out = np.zeros(total, np.uint64)
    padded = np.append(value, np.zeros(width, np.uint64))
    for j in range(width):
        more = common.mix(out * np.uint64(0xD6E8FEB86659FD93) + padded[place + j] + np.uint64(j + 1))
        out = np.where(words_left > j, more, out)
    return out, offsets


def sketches(least: np.ndarray) -> np.ndarray:
    """PLANES bits of each coordinate of the signatures (rows of least): for each bit in turn, that of all coordinates in 64-bit words."""
    words = -(-least.shape[1] // 64)
    out = np.zeros((len(least), PLANES, words * 8), np.uint8)
    for p in range(PLANES):
        packed = np.packbits(((least >> np.uint32(p)) & np.uint32(1)).astype(np.uint8), axis=1, bitorder="little")
        out[:, p, : packed.shape[1]] = packed
    return out.reshape(len(least), -1).view(np.int64)


def signatures(documents: DataFrame, width: int, coordinates: int = COORDINATES, posted: int = POSTED) -> DataFrame:
    """doc_id, n_shingles, set_key (a digest of the set, null if empty), signature (its first `posted` coordinates, array<int>, null
    if empty), sketch (of all coordinates, array<bigint>, null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text", 2_000_000):
            hashes, offsets = shingle_hashes(*common.text_bytes(part.column("text")), width)
            sets = [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            sizes = np.array([len(s) for s in sets], np.int64)
            full = sizes > 0
            begins = (np.cumsum(sizes) - sizes)[full]
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            least = np.empty((int(full.sum()), coordinates), np.uint32)
            for k in range(coordinates if len(flat) else 0):
                least[:, k] = np.minimum.reduceat(((flat * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), begins)
            lists = [pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(m.reshape(-1))) for m in (least[:, :posted].view(np.int32), sketches(least))]
            where = np.where(full, np.cumsum(full) - 1, 0)
            rows = pa.array(where, pa.int64(), mask=~full)
            keys = pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(sizes), keys, *(x.take(rows) for x in lists)], names=["doc_id", "n_shingles", "set_key", "signature", "sketch"])

    return common.map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id bigint, n_shingles bigint, set_key binary, signature array<int>, sketch array<bigint>")


def full_sets(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, set_key, members (array<bigint>, sorted) of (doc_id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text", 1_000_000):
            hashes, offsets = shingle_hashes(*common.text_bytes(part.column("text")), width)
            sets = [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            members = pa.ListArray.from_arrays(np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32), pa.array((np.concatenate(sets) if sets else np.zeros(0, np.uint64)).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()), members], names=["doc_id", "set_key", "members"])

    return common.map_batches(documents, run, "doc_id bigint, set_key binary, members array<bigint>")


def connected(links: DataFrame) -> DataFrame:
    """(a, b) links -> (id, component): the least id reachable, for each id that reaches a lesser one."""
    return graph.stars(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("u").alias("id"), F.col("v").alias("component"))


class _Join:
    """The rounds of the inverted join over one table of classes (id, doc_id, set_key, n, signature, sketch)."""

    def __init__(self, documents: DataFrame, classes: DataFrame, links: DataFrame | None, width: int, percent: int, coordinates: int, matches: int, posted_matches: int, few: int, repeats: bool):
        self.repeats = repeats  # whether rows share both id and set
        self.documents, self.classes, self.links = documents, classes, links
        self.width, self.percent, self.coordinates, self.matches, self.posted_matches, self.few = width, percent, coordinates, matches, posted_matches, few
        self.several = links is not None  # whether rows of different sets share an id
        self.labels = connected(links) if self.several else None

    def alike(self, n: Column, m: Column, one: Column, two: Column) -> Column:
        """Whether sets of these sizes and sketches can be alike enough at all."""
        words = -(-self.coordinates // 64)
        differ = [reduce(Column.bitwiseOR, [one[p * words + w].bitwiseXOR(two[p * words + w]) for p in range(PLANES)]) for w in range(words)]
        return (F.least(n, m) * 100 >= F.greatest(n, m) * self.percent) & (sum(map(F.bit_count, differ), F.lit(0)) <= self.coordinates - self.matches)

    def elements(self) -> DataFrame:
        """(id, element, times): what classes share with others, with the number of classes that have it."""
        spread = self.classes.select("id", F.posexplode("signature").alias("k", "value"))
        spread = spread.select("id", (F.shiftleft(F.col("k").cast("long"), 32) + F.col("value").cast("long") + F.lit(1 << 31)).alias("element"))
        shared = spread.groupBy("element").agg(F.count("*").alias("times")).where("times > 1")
        return spread.join(common.moved(shared), "element")

    def prefixes(self, elements: DataFrame) -> DataFrame:
        """key, times, id, n, sketch: each class's rarest elements, all but the last posted_matches - 1. A class has at most a
        signature's length."""
        all_ = elements.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("times", "element"))).alias("all")).where(F.size("all") >= self.posted_matches)
        all_ = all_.select("id", F.slice("all", F.lit(1), F.size("all") - F.lit(self.posted_matches - 1)).alias("rarest"))
        one = all_.join(common.moved(self.classes.select("id", "n", "sketch")), "id").select("id", "n", "sketch", F.explode("rarest").alias("one"))
        return one.select(F.col("one.element").alias("key"), "one.times", "id", "n", "sketch")

    def alike_in_lists(self, postings: DataFrame) -> DataFrame:
        """key, id, n, sketch, salts: postings without the members of short lists that are alike with no other member; salts: among
        how many tasks a list is dealt. Long lists pass in parts, as they are."""
        part = F.when(F.col("times") > SHORT, F.pmod(F.xxhash64("id"), F.ceil(F.col("times") / SHORT))).otherwise(0).alias("part")
        lists = postings.groupBy("key", "times", part).agg(F.collect_list(F.struct("id", "n", "sketch")).alias("all"))
        partner = lambda x: F.exists("all", lambda y: (x["id"] != y["id"]) & self.alike(x["n"], y["n"], x["sketch"], y["sketch"]))
        one = lists.select("key", "times", F.explode(F.when(F.col("times") > SHORT, F.col("all")).otherwise(F.filter("all", partner))).alias("one"))
        return one.select("key", "one.id", "one.n", "one.sketch", F.ceil(F.col("times") / SALT_ROWS).cast("int").alias("salts"))

    def with_lists(self, members: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
        """members joined with rows of lists (keys, salts and others) by key and salt."""
        dealt = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("salts")
        return dealt.join(common.moved(lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))), [*keys, "salt"]).drop("salt")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Distinct candidate pairs (a, b, total: the sum of their sets' sizes) -> the links (a, b) among them: those whose full sets are alike."""
        near = common.stash(pairs, "minhash-near")
        ids = near.select(F.col("a").alias("id")).union(near.select("b"))
        sets = common.stash(self.sets(ids), "minhash-sets", codec="lz4")
        one, two = (common.moved(sets.select(F.col("id").alias(c), F.col("members").alias(f"m{c}"))) for c in ("a", "b"))
        both = near.join(two, "b").join(one, "a")
        both = both.withColumn("shared", F.size(F.array_intersect("ma", "mb")).cast("long"))
        return common.stash(both.where(F.col("shared") * 100 >= (F.col("total") - F.col("shared")) * self.percent).select("a", "b"), "minhash-links")

    def sets(self, ids: DataFrame) -> DataFrame:
        """id, members: the full sets of classes, one row each, made from their documents' texts once more. ids may repeat. Of all
        texts only those of these documents, and a few others, are moved."""
        wanted = self.classes.select("id", "doc_id", "set_key").join(common.moved(ids), "id", "left_semi")
        documents = common.among(self.documents, "doc_id", wanted.select("doc_id"))
        if not self.several and not self.repeats:  # an id has one row
            texts = documents.join(common.moved(wanted.select("id", "doc_id")), "doc_id").select(F.col("id").alias("doc_id"), "text")
            return full_sets(texts, self.width).select(F.col("doc_id").alias("id"), "members")
        made = full_sets(documents.join(common.moved(wanted.select("doc_id")), "doc_id", "left_semi"), self.width)
        if self.repeats:  # else an id has one set of a key
            made = made.dropDuplicates(["doc_id", "set_key"])
        return made.join(common.moved(wanted), ["doc_id", "set_key"]).select("id", "members")

    def add(self, new: DataFrame) -> None:
        self.labels = connected(new if self.links is None else self.links.union(new))
        # Links within a component are told by its tree as well, and there are far fewer of those.
        self.links = self.labels.select(F.col("id").alias("a"), F.col("component").alias("b"))

    def labelled(self, postings: DataFrame) -> DataFrame:
        if self.labels is None:
            return postings.withColumn("label", F.col("id"))
        return postings.join(common.moved(self.labels), "id", "left").select(*postings.columns, F.coalesce("component", "id").alias("label"))

    def open_lists(self, postings: DataFrame) -> DataFrame:
        """postings of lists that span several components, with label, main (the largest one) and outside (members beyond it)."""
        members = common.stash(self.labelled(postings), "minhash-labelled")
        tally = members.groupBy("key", "salts", "label").agg(F.count("*").alias("c"))
        lists = tally.groupBy("key", "salts").agg(F.max_by("label", F.struct("c", "label")).alias("main"), (F.sum("c") - F.max("c")).alias("outside")).where("outside > 0")
        return common.stash(self.with_lists(members, lists, ["key"]), "minhash-open")

    def against_first(self, postings: DataFrame) -> DataFrame:
        """Candidate pairs of each member and the least leader of its lists; a list's leader is its least id."""
        leaders = postings.groupBy("key", "salts").agg(F.min(F.struct("id", "n", "sketch")).alias("l"))
        met = self.with_lists(postings, leaders, ["key"]).where((F.col("id") != F.col("l.id")) & self.alike(F.col("n"), F.col("l.n"), F.col("sketch"), F.col("l.sketch")))
        return met.groupBy("id").agg(F.min(F.struct(F.col("l.id").alias("a"), (F.col("l.n") + F.col("n")).alias("total"))).alias("l")).select("l.a", F.col("id").alias("b"), "l.total")

    def against_leaders(self, open_: DataFrame) -> DataFrame:
        """Candidate pairs of members outside their list's main component: with a leader of each main component, and with
        a leader of those outside. Leaders are drawn anew by each list."""
        drawn = F.struct(F.xxhash64("key", "id").alias("o"), "id", "n", "label", "sketch")
        inside = F.col("label") == F.col("main")
        leaders = open_.groupBy("key", "salts").agg(F.min(F.when(inside, drawn)).alias("l"), F.min(F.when(~inside, drawn)).alias("m"))
        out = self.with_lists(open_.where(~inside), leaders, ["key"])
        meets = lambda l: self.alike(F.col("n"), F.col(f"{l}.n"), F.col("sketch"), F.col(f"{l}.sketch"))
        of = lambda l, main: F.struct(main.alias("main"), F.col(f"{l}.id").alias("a"), (F.col("n") + F.col(f"{l}.n")).alias("total"))
        one = F.when(meets("l"), of("l", F.col("main")))
        two = F.when((F.col("label") != F.col("m.label")) & meets("m"), of("m", F.lit(None).cast("long")))
        met = out.select("id", F.explode(F.array(one, two)).alias("met")).where("met is not null")
        both = met.groupBy("id", "met.main").agg(F.min(F.struct("met.a", "met.total")).alias("l"))
        return both.select(F.least("id", "l.a").alias("a"), F.greatest("id", "l.a").alias("b"), "l.total").distinct()

    def outside_against_all(self, members: DataFrame) -> DataFrame:
        """Candidate pairs of the members outside each list's main component and all its members of other components."""
        out = members.where("label <> main").select("key", "salts", F.col("id").alias("o"), F.col("n").alias("on"), F.col("label").alias("ol"), F.col("sketch").alias("os"))
        met = self.with_lists(members, out, ["key"]).where((F.col("label") != F.col("ol")) & self.alike(F.col("n"), F.col("on"), F.col("sketch"), F.col("os")))
        return met.select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b"), (F.col("n") + F.col("on")).alias("total")).distinct()

    def cells(self, parties: DataFrame, block: int, *columns: str) -> DataFrame:
        """parties (main, id, label, out, ...) dealt to blocks: outside, main, id, label, columns, bx, by. The outside documents of a main
        component meet all of it, a block has about so many documents of either side, however many there are in all."""
        counts = parties.groupBy("main").agg(F.ceil(F.count_if("out") / block).alias("x"), F.ceil(F.count("*") / block).alias("y"))
        place = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
        every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        left = F.transform(every("y"), lambda y: F.struct(F.lit(True).alias("outside"), place("x").alias("bx"), y.alias("by")))
        right = F.transform(every("x"), lambda x: F.struct(F.lit(False).alias("outside"), x.alias("bx"), place("y").alias("by")))
        cells = parties.join(counts, "main").where("x > 0").select("main", "id", "label", *columns, F.explode(F.when(F.col("out"), F.concat(left, right)).otherwise(right)).alias("cell"))
        return cells.select("cell.outside", "main", "id", "label", *columns, "cell.bx", "cell.by")

    def in_blocks(self, members: DataFrame) -> DataFrame:
        """Links (a, b) of the members outside each main component with all members of its lists."""
        percent, coordinates, matches = self.percent, self.coordinates, self.matches
        parties = common.stash(members.select("main", "id", "n", "sketch", "label", (F.col("label") != F.col("main")).alias("out")).dropDuplicates(["main", "id"]), "minhash-parties")
        blocks = self.cells(parties, SKETCH_BLOCK, "n", "sketch").groupBy("main", "bx", "by")
        met = blocks.applyInArrow(lambda t: _block_alike(t, percent, coordinates, matches), "main bigint, id bigint")
        parties = common.stash(parties.drop("n", "sketch").join(common.moved(met), ["main", "id"], "left_semi"), "minhash-parties")
        sets = common.stash(self.sets(parties.select("id")), "minhash-block-sets", codec="lz4")
        blocks = self.cells(parties.join(common.moved(sets), "id"), BLOCK, "members").groupBy("main", "bx", "by")
        return common.stash(blocks.applyInArrow(lambda t: _block_links(t, percent), "a bigint, b bigint"), "minhash-links")

    def run(self) -> DataFrame | None:
        """(id, component) of all classes that have a link."""
        postings = common.stash(self.alike_in_lists(self.prefixes(self.elements())), "minhash-postings")
        self.add(self.confirm(self.against_first(postings)))
        open_ = self.open_lists(postings)
        if open_.isEmpty():
            return self.labels
        self.add(self.confirm(self.against_leaders(open_)))
        open_ = self.open_lists(open_.select("id", "n", "sketch", "key", "salts"))
        links = self.confirm(self.outside_against_all(open_.where(F.col("outside") <= self.few)))
        many = open_.where(F.col("outside") > self.few)
        self.add(links if many.isEmpty() else links.union(self.in_blocks(many)))
        return self.labels


def _block_alike(block: pa.Table, percent: int, coordinates: int, matches: int) -> pa.Table:
    """main, id: the block's documents, outside ones and others, whose sketches and sizes let them be alike with one of another component
    on the other side."""
    block = block.combine_chunks()
    outside = np.asarray(block.column("outside").to_numpy(), bool)
    ids, labels, n = (block.column(c).to_numpy() for c in ("id", "label", "n"))
    sketch = block.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), PLANES, -1)
    left, right = np.flatnonzero(outside), np.flatnonzero(~outside)
    found = np.zeros(len(ids), bool)
    for some in np.array_split(left, -(-len(left) // 64)) if len(left) else []:
        differ = np.bitwise_or.reduce(sketch[some][:, None] ^ sketch[right][None], axis=2)
        met = np.bitwise_count(differ).sum(2, dtype=np.int64) <= coordinates - matches
        met &= (labels[some][:, None] != labels[right][None]) & (np.minimum(n[some][:, None], n[right][None]) * 100 >= np.maximum(n[some][:, None], n[right][None]) * percent)
        found[some] = met.any(1)
        found[right] |= met.any(0)
    return pa.table({"main": block.column("main").filter(pa.array(found)), "id": pa.array(ids[found])})


def _block_links(block: pa.Table, percent: int) -> pa.Table:
    """The links of a block's outside documents with its other ones, one for each component that a document meets."""
    block = block.combine_chunks()
    outside = np.asarray(block.column("outside").to_numpy(), bool)
    ids, labels = block.column("id").to_numpy(), block.column("label").to_numpy()
    lists = block.column("members").combine_chunks()
    at = lists.offsets.to_numpy()
    value = lists.values.to_numpy()[at[0] : at[-1]]
    owner = np.repeat(np.arange(len(ids)), np.diff(at))
    sizes = np.diff(at)
    left, right = np.flatnonzero(outside), np.flatnonzero(~outside)
    row = np.empty(len(ids), np.int64)
    row[left], row[right] = np.arange(len(left)), np.arange(len(right))
    _, code = np.unique(value, return_inverse=True)
    here = np.zeros((2, int(code.max(initial=-1)) + 1), bool)
    here[0, code[outside[owner]]] = True
    here[1, code[~outside[owner]]] = True
    number = np.cumsum(here.all(0)) - 1  # only what either side has counts
    keep = here.all(0)[code]
    code, owner = number[code[keep]], owner[keep]
    shared = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(code.max(initial=-1)) + 1, 4096):
        some = (code >= first) & (code < first + 4096)
        a, b = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
        o, c = owner[some], code[some] - first
        a[row[o[outside[o]]], c[outside[o]]] = 1
        b[row[o[~outside[o]]], c[~outside[o]]] = 1
        shared += a @ b.T
    linked = (100 * shared >= percent * (sizes[left][:, None] + sizes[right][None, :] - shared)) & (labels[left][:, None] != labels[right][None, :])
    x, y = np.nonzero(linked)
    _, one = np.unique(np.stack([x, labels[right][y]], 1), axis=0, return_index=True) if len(x) else (None, np.zeros(0, np.int64))
    a, b = ids[left][x[one]], ids[right][y[one]]
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES, posted: int = POSTED, posted_matches: int = POSTED_MATCHES, few: int = FEW) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept: a row for each row.

    width: words in a shingle; percent: the least Jaccard similarity of a link, times 100; coordinates, matches: the
    signature's length and the agreements (on PLANES bits of each) that make a candidate; posted, posted_matches: the same for the coordinates
    under which documents are posted (at 64 and 35, 32 and 13 a pair at 80 % is missed once in 700,000 times, one at 85 %
    once in 370 million); few: see FEW."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = common.stash(signatures(documents, width, coordinates, posted), "minhash-signed")
    classes = signed.where("doc_id is not null and set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch"))
    classes = common.stash(classes.withColumn("id", F.monotonically_increasing_id()), "minhash-classes")
    placed = common.stash(signed.drop("signature", "sketch").join(common.moved(classes.select("set_key", "id")), "set_key", "left").drop("set_key"), "minhash-placed")
    links, repeats = None, False
    rows = placed.where("doc_id is not null and id is not null").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("c")).where("c > 1")
    if not rows.isEmpty():
        several = rows.where("a < b")
        if not several.isEmpty():  # ids with rows of different texts
            links = placed.join(common.moved(several.select("doc_id", "a")), "doc_id").where("id <> a").select("a", F.col("id").alias("b")).distinct()
        repeats = not placed.where("doc_id is not null and id is not null").groupBy("doc_id", "id").count().where("count > 1").isEmpty()
    labels = _Join(documents, classes, links, width, percent, coordinates, matches, posted_matches, few, repeats).run()
    if labels is None:
        labels = classes.select("id", F.col("id").alias("component")).limit(0)
    named = classes.select("id", F.col("doc_id").alias("least")).join(common.moved(labels), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = named.join(common.moved(least), "component").select("id", "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = placed.join(common.moved(of_class), "id", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
