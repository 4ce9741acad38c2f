"""Hard-negative mining with a vector-approximation file.

Vectors are dealt into blocks. Inside a block, every dimension is cut into CELLS cells that hold about equally many of the
block's values, and a vector is kept as its cells, two dimensions to a byte, besides its exact components. An anchor's
lower and upper score bounds come from tables: for each pair of dimensions and each of the 256 pairs of cells the least and
the greatest share of the score, so a candidate costs two look-ups for two dimensions. Only candidates whose bounds let them
into a window are scored exactly: for positives the window above the k-th best lower bound of the same label; for negatives,
for each positive score, the scores between `percent` per cent of it and itself, and of these what can be among the first k.

Anchors are a stated set of rows; they are packed into blocks too, and each block of anchors meets each block of vectors once
for positives and once for negatives. A cell of this grid returns at most k rows for an anchor (and positive score), and the
best of these are taken per anchor. Blocks are dealt by a hash of the row, so copies of a vector do not gather anywhere.

Defined cases: rows with a null id, label or vector, with a null or non-finite component, or with a component of more than
LARGEST after scaling take no part (so that no score overflows); a row's positives and negatives have vectors of its own
length; rows that are equal in all three columns count once, and rows that share an id are never each other's positive or
negative; empty vectors score 0; an anchor without positives, or a positive without negatives, gives no row; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillwater.llm import common

CELLS = 16
#: Rows of a block of vectors and of a block of anchors.
ROWS, ANCHORS = 8_192, 256
#: Blocks of anchors that a task takes for a block of vectors.
AT_ONCE = 4
#: Components beyond this size after scaling: 2^24 squared leaves room for 2^15 dimensions.
LARGEST = 1 << 24

_BLOCK = "d int, block bigint, n bigint, ids binary, labels binary, vectors binary, codes binary, low binary, high binary"


def usable(vectors: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """vec_id, label (int, the given column), vector (array<long>: floor(scale * x)) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.where("vec_id is not null and label is not null and embedding is not null")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) * scale > LARGEST))
    return v.where(~bad).select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x * scale).cast("long")).alias("vector")).distinct()


def _pairs(matrix: np.ndarray) -> np.ndarray:
    """Cells of single dimensions (n, d) -> cells of pairs of dimensions (pairs, n)."""
    if matrix.shape[1] % 2:
        matrix = np.concatenate([matrix, np.zeros((len(matrix), 1), np.uint8)], 1)
    return np.ascontiguousarray((matrix[:, 0::2] * CELLS + matrix[:, 1::2]).T)


def approximate(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """codes (pairs of dimensions, n), and the least and the greatest value in each cell of each dimension (d, CELLS)."""
    n, d = matrix.shape
    cells = np.zeros((n, d), np.uint8)
    low, high = np.zeros((d, CELLS), np.int64), np.zeros((d, CELLS), np.int64)
    for j in range(d):
        column = matrix[:, j]
        marks = np.sort(column)[np.arange(1, CELLS) * n // CELLS]
        cells[:, j] = cell = np.searchsorted(marks, column, "right")
        order = np.argsort(cell, kind="stable")
        used, first = np.unique(cell[order], return_index=True)
        low[j, used] = np.minimum.reduceat(column[order], first)
        high[j, used] = np.maximum.reduceat(column[order], first)
    return _pairs(cells), low, high


def tables(anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of dimensions (pairs, 256): the least and the greatest share of the anchor's score."""
    one, two = anchor[:, None] * low, anchor[:, None] * high
    least, most = np.minimum(one, two), np.maximum(one, two)
    if len(anchor) % 2:
        least, most = (np.concatenate([x, np.zeros((1, CELLS), np.int64)]) for x in (least, most))
    return tuple((x[0::2, :, None] + x[1::2, None, :]).reshape(-1, CELLS * CELLS) for x in (least, most))


def bounds(anchor: np.ndarray, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score that each approximated vector can have."""
    least, most = np.zeros(codes.shape[1], np.int64), np.zeros(codes.shape[1], np.int64)
    for code, a, b in zip(codes, *tables(anchor, low, high), strict=True):
        least += a[code]
        most += b[code]
    return least, most


class Block:
    """A vector-approximation file: rows sorted by label and id, their approximations and exact vectors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, codes: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.ids, self.labels, self.vectors, self.codes, self.low, self.high = ids, labels, vectors, codes, low, high
        self.scored = 0

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Block:
        order = np.lexsort((ids, labels))
        return cls(ids[order], labels[order], vectors[order], *approximate(vectors[order]))

    def best(self, anchor: np.ndarray, rows: np.ndarray, least: np.ndarray, most: np.ndarray, k: int, floor: int | None = None, top: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the first k of `rows` whose scores lie between floor and top, by score down, then id. least, most:
        the rows' bounds. Rows that certainly lie in the window bound what can still be among the first k."""
        sure = least if floor is None else least[(least >= floor) & (most <= top)]
        may = np.ones(len(rows), bool) if floor is None else (most >= floor) & (least <= top)
        if len(sure) > k:
            may &= most >= np.partition(sure, len(sure) - k)[len(sure) - k]
        rows = rows[may]
        self.scored += len(rows)
        scores = self.vectors[rows] @ anchor
        if floor is not None:
            inside = (scores >= floor) & (scores <= top)
            rows, scores = rows[inside], scores[inside]
        order = np.lexsort((self.ids[rows], -scores))
        order = order[np.sort(np.unique(self.ids[rows][order], return_index=True)[1])][:k] if len(order) else order  # an id by its best row
        return self.ids[rows][order], scores[order]

    def positives(self, anchor_id: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first k other rows of the label."""
        a, b = np.searchsorted(self.labels, [label, label + 1])
        least, most = bounds(anchor, self.codes[:, a:b], self.low, self.high)
        other = self.ids[a:b] != anchor_id
        return self.best(anchor, np.arange(a, b)[other], least[other], most[other], k)

    def negatives(self, anchor_id: int, label: int, anchor: np.ndarray, scores: np.ndarray, percent: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each positive score, the first k rows of other labels between percent per cent of it and itself."""
        rows = np.flatnonzero((self.labels != label) & (self.ids != anchor_id))
        least, most = bounds(anchor, self.codes, self.low, self.high)
        least, most = least[rows], most[rows]
        return [self.best(anchor, rows, least, most, k, -(-percent * s // 100), s) for s in scores.tolist()]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def blocks(vectors: DataFrame, rows: int = ROWS) -> DataFrame:
    """usable() -> a row for each block: its rows, approximations and cells as bytes, in shared storage."""
    counts = vectors.groupBy(F.size("vector").alias("d")).agg(F.ceil(F.count("*") / rows).alias("blocks"))  # a row for each length

    def one(part: pa.Table) -> pa.Table:
        ids, labels = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
        b = Block.of(ids, labels, _matrix(part.column("vector").combine_chunks()))
        data = {"ids": b.ids, "labels": b.labels, "vectors": b.vectors, "codes": b.codes, "low": b.low, "high": b.high}
        head = {"d": pa.array([b.vectors.shape[1]], pa.int32()), "block": part.column("block").slice(0, 1), "n": pa.array([len(ids)], pa.int64())}
        return pa.table(head | {k: pa.array([v.tobytes()], pa.binary()) for k, v in data.items()})

    dealt = vectors.join(counts, F.size("vector") == F.col("d")).select("vec_id", "label", "vector", "d", F.pmod(F.xxhash64("vec_id", "label", "vector"), F.col("blocks")).alias("block"))
    return common.stash(dealt.groupBy("d", "block").applyInArrow(one, _BLOCK), "negatives-blocks", codec="lz4")


def anchor_blocks(anchors: DataFrame, rows: int) -> DataFrame:
    """anchors (key, vec_id, label, vector, scores: those of its positives) -> d, data: about `rows` of one length as one value."""
    kind = [("key", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int32()), ("vector", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64()))]
    names = [n for n, _ in kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}

        def block(d: int) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            table = pa.Table.from_pylist(held.pop(d), schema=pa.schema(kind))
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["d", "data"])

        for batch in batches:
            for row in batch.select(names).to_pylist():
                d = len(row["vector"])
                held.setdefault(d, []).append(row)
                if len(held[d]) >= rows:
                    yield block(d)
        for d in list(held):
            yield block(d)

    return common.stash(common.map_batches(anchors.select(*names), run, "d int, data binary"), "negatives-anchors", codec="lz4")


def _cells(files: DataFrame, asked: DataFrame, answer: Callable, schema: str) -> DataFrame:
    """answer(block, anchors) for each block of vectors and block of anchors of its length. A task takes a block of vectors and
    about AT_ONCE blocks of anchors: anchors are sent to every block, blocks of vectors to as many tasks as that needs."""
    lengths = files.groupBy("d").agg((F.max("block") + 1).alias("blocks"))  # a row for each length
    numbered = asked.withColumn("a", F.monotonically_increasing_id())
    parts = max(1, -(-asked.count() // AT_ONCE))
    tasks = max(1, files.count() * parts)
    sent = numbered.join(lengths, "d").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sent = sent.select("d", "block", F.pmod(F.xxhash64("a"), F.lit(parts)).cast("int").alias("part"), "data").repartition(tasks, "d", "block", "part")
    held = files.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(tasks, "d", "block", "part")

    def run(file: pa.Table, anchors: pa.Table) -> pa.Table:
        if not file.num_rows or not anchors.num_rows:
            return answer(None, None)
        row = file.to_pylist()[0]
        get = lambda c, t: np.frombuffer(row[c], t)
        n, d = row["n"], row["d"]
        block = Block(get("ids", np.int64), get("labels", np.int32), get("vectors", np.int64).reshape(n, d), get("codes", np.uint8).reshape(-1, n), get("low", np.int64).reshape(d, CELLS), get("high", np.int64).reshape(d, CELLS))
        return answer(block, pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in anchors.column("data").to_pylist()]))

    return held.groupBy("d", "block", "part").cogroup(sent.groupBy("d", "block", "part")).applyInArrow(run, schema)


def _columns(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    """rows of (scalars or arrays of one length) as a table of longs."""
    columns = [np.concatenate([np.broadcast_to(r[i], len(r[-1])) for r in rows]) if rows else np.zeros(0) for i in range(len(names))]
    return pa.table({n: pa.array(np.asarray(c, np.int64)) for n, c in zip(names, columns, strict=True)})


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256, rows: int = ROWS, anchor_rows: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows with is_anchor (a Column of vec_id);
    label: a Column of vec_id and label that gives the label to use."""
    taking = common.stash(usable(vectors, label, scale), "negatives-vectors")
    files = blocks(taking, rows)
    # An anchor is a row, told by its digest and id: its id may have others.
    anchors = taking.where(is_anchor).select(F.xxhash64("vec_id", "label", "vector").alias("key"), "*", F.array().cast("array<bigint>").alias("scores"))

    def near(block: Block | None, asked: pa.Table | None) -> pa.Table:
        found = [] if asked is None else [(row["key"], row["vec_id"], *block.positives(row["vec_id"], row["label"], np.array(row["vector"], np.int64), positives)) for row in asked.to_pylist()]
        return _columns(found, ("key", "anchor_id", "positive_id", "positive_score"))

    one = _cells(files, anchor_blocks(anchors, anchor_rows), near, "key bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
    one = one.groupBy("key", "anchor_id", "positive_id").agg(F.max("positive_score").alias("positive_score"))
    order = Window.partitionBy("key", "anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = common.stash(one.withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives).drop("r"), "negatives-positives")

    def hard(block: Block | None, asked: pa.Table | None) -> pa.Table:
        found = []
        for row in [] if asked is None else asked.to_pylist():
            scores = np.array(row["scores"], np.int64)
            made = block.negatives(row["vec_id"], row["label"], np.array(row["vector"], np.int64), scores, percent, negatives)
            found += [(row["key"], row["vec_id"], s, ids, values) for s, (ids, values) in zip(scores.tolist(), made, strict=True)]
        return _columns(found, ("key", "anchor_id", "positive_score", "negative_id", "negative_score"))

    wanted = chosen.groupBy("key", F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("scores"))  # at most `positives`
    asked = anchor_blocks(anchors.drop("scores").join(wanted, ["key", "vec_id"]), anchor_rows)
    two = _cells(files, asked, hard, "key bigint, anchor_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    two = two.groupBy("key", "anchor_id", "positive_score", "negative_id").agg(F.max("negative_score").alias("negative_score"))
    order = Window.partitionBy("key", "anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    kept = two.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return chosen.join(kept, ["key", "anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
