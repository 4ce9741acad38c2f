"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Rows are dealt to shards of about `shard_rows` by a hash of id and vector. A task builds its shard's graph in numpy,
inserting points in batches: the batch searches the graph of those before it layer by layer, each point keeps
diverse neighbours among what was found and among its own batch, and links back. A layer is a flat array of
neighbour lists of fixed width. Nearness is the largest inner product; graphs are built on vectors that are
extended by one component to equal length, on which the order of distances is that of inner products.

Indexes are rows of a table in shared storage: ids, vectors and flat neighbour arrays as bytes. Queries come in
blocks; a task loads one index and searches it for several blocks, by a beam for all queries of a block at once, and
the best of all shards are merged by a top-k that each shard has reduced already. Scores are then taken from the
original vectors in double precision.

Indexes hold every distinct (id, vector) once, whatever the number of its rows. Equal vectors in a shard are one
point of its graph; the point's ids are listed in order, and of these a search needs no more than it returns. A
shard's best are chosen among ids, each by its best vector; where the points found have fewer than k ids, the beam
is doubled until they have or all points are found.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; an inner product
is between vectors of one length, so each length has shards of its own, which only queries of that length search; null
ids take no part; rows that share an id are one query each, and one candidate together, by the best of its distinct
vectors (0.0 and -0.0 are equal); fewer candidates than k give all; empty tables give empty tables; only vec_id and
embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillwater.llm import common

SHARD_ROWS, LINKS, BUILD_BEAM, SEARCH_BEAM, QUERY_BLOCK, BLOCKS_AT_ONCE = 8_192, 16, 96, 128, 512, 8


# --------------------------------------------------------------------------- one graph


@dataclass
class Graph:
    """points: extended vectors. members[layer]: the points of a layer; links[layer]: for each of these its
    neighbours (numbers of points, -1 behind the last), in a flat array of fixed width."""

    points: np.ndarray
    members: list[np.ndarray]
    links: list[np.ndarray]

    @property
    def entry(self) -> int:
        return int(self.members[-1][0])


def extend(vectors: np.ndarray) -> np.ndarray:
    """One component more, so that all have the length of the longest."""
    squares = np.einsum("ij,ij->i", vectors, vectors)
    return np.concatenate([vectors, np.sqrt(np.maximum(0.0, squares.max(initial=0.0) - squares))[:, None]], 1).astype(np.float32)


def _beam(points: np.ndarray, place: np.ndarray | None, links: np.ndarray, queries: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The `width` nearest points that a best-first walk finds from each query's starts (q x s, -1 for none): numbers
    and similarities, nearest first. place: a point's row in links; None if they are the same."""
    q = len(queries)
    rows = np.arange(q)
    visited = np.zeros((q, len(points) + 1), bool)  # the last column takes -1
    found = np.full((q, width), -1, np.int32)
    near = np.full((q, width), -np.inf, np.float32)
    open_ = np.zeros((q, width), bool)
    fresh = starts
    while True:
        s = np.einsum("qd,qsd->qs", queries[rows], points[fresh])
        s[fresh < 0] = -np.inf
        visited[rows[:, None], fresh] = True
        ids = np.concatenate([found[rows], fresh], 1)
        sims = np.concatenate([near[rows], s], 1)
        unseen = np.concatenate([open_[rows], fresh >= 0], 1)
        best = np.argpartition(-sims, width - 1, 1)[:, :width] if sims.shape[1] > width else np.tile(np.arange(sims.shape[1]), (len(rows), 1))
        found[rows], near[rows], open_[rows] = (np.take_along_axis(x, best, 1) for x in (ids, sims, unseen))
        waiting = np.where(open_, near, -np.inf)
        at = waiting.argmax(1)
        rows = np.flatnonzero(waiting[np.arange(q), at] > -np.inf)
        if not len(rows):
            break
        at = at[rows]
        open_[rows, at] = False
        current = found[rows, at]
        fresh = links[current if place is None else place[current]].copy()
        fresh[visited[rows[:, None], fresh]] = -1
    order = np.argsort(-near, 1, kind="stable")
    return np.take_along_axis(found, order, 1), np.take_along_axis(near, order, 1)


def _diverse(points: np.ndarray, candidates: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of candidates (n x c, nearest first, -1 for none) those nearer to their point than to any one taken before,
    filled up with the nearest others: n x most."""
    n, c = candidates.shape
    vectors = points[candidates]
    taken = np.zeros((n, c), bool)
    closest = np.full((n, c), -np.inf, np.float32)  # similarity to the nearest one taken
    rank = np.full((n, c), 2 * c, np.int32)
    for j in range(c):
        ok = (candidates[:, j] >= 0) & (sims[:, j] > closest[:, j]) & (taken.sum(1) < most)
        taken[:, j] = ok
        rank[ok, j] = j
        some = np.flatnonzero(ok)
        if len(some) and j + 1 < c:
            closest[some, j + 1 :] = np.maximum(closest[some, j + 1 :], np.einsum("nd,ncd->nc", vectors[some, j], vectors[some, j + 1 :]))
    rest = (candidates >= 0) & ~taken
    rank[rest] = (np.broadcast_to(np.arange(c), (n, c)) + c)[rest]
    order = np.argsort(rank, 1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(rank, order, 1) < 2 * c, np.take_along_axis(candidates, order, 1), -1)
    return out if c >= most else np.concatenate([out, np.full((n, most - c), -1, out.dtype)], 1)


def _link_back(points: np.ndarray, place: np.ndarray, links: np.ndarray, new: np.ndarray, theirs: np.ndarray) -> None:
    """Add each new point to the lists of the neighbours it took; lists that overflow keep diverse ones."""
    source = np.repeat(new, theirs.shape[1])
    target = theirs.ravel()
    source, target = source[target >= 0], target[target >= 0]
    if not len(target):
        return
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    first = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
    column = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
    more = np.full((len(first), int(column.max()) + 1), -1, np.int32)
    more[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(target)))), column] = source
    hosts = target[first]
    old = links[place[hosts]]
    for at in range(0, len(hosts), 512):
        h = hosts[at : at + 512]
        mine, theirs_ = old[at : at + 512], more[at : at + 512]
        both = (theirs_[:, :, None] == mine[:, None, :]).any(2)  # points of one batch may have taken each other
        candidates = np.concatenate([mine, np.where(both, -1, theirs_)], 1)
        sims = np.einsum("nd,ncd->nc", points[h], points[candidates])
        sims[candidates < 0] = -np.inf
        order = np.argsort(-sims, 1, kind="stable")
        candidates, sims = np.take_along_axis(candidates, order, 1), np.take_along_axis(sims, order, 1)
        used = max(1, int((candidates >= 0).sum(1).max()))
        links[place[h]] = _diverse(points, candidates[:, :used], sims[:, :used], links.shape[1])


def build(points: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 3) -> Graph:
    n = len(points)
    level = np.minimum(8, np.random.default_rng(seed).exponential(1 / np.log(links), n).astype(int))
    # Points go in by level, so that every layer is complete from its first points on, and the entry is fixed.
    order = np.argsort(-level, kind="stable")
    points, level = points[order], level[order]
    top = int(level[0])
    counts = [int((level >= k).sum()) for k in range(top + 1)]
    members = [np.arange(c) for c in counts]
    place = np.arange(n)
    lists = [np.full((c, 2 * links if k == 0 else links), -1, np.int32) for k, c in enumerate(counts)]
    at = 1
    while at < n:
        size = min(256, max(1, at // 2), n - at)
        new = np.arange(at, at + size)
        vectors = points[new]
        starts = np.zeros((size, 1), np.int32)
        for k in range(top, -1, -1):
            # Points of the batch are in a layer if they are among its first; the batch is sorted by level.
            here = int((level[new] >= k).sum())
            known = min(at, counts[k])
            found, near = _beam(points, None, lists[k], vectors, starts, beam if here else 1) if known else (starts, None)
            if here:
                mine = new[:here]
                among = vectors[:here] @ vectors[:here].T
                np.fill_diagonal(among, -np.inf)
                candidates = np.concatenate([found[:here], np.broadcast_to(mine, (here, here))], 1)
                sims = np.concatenate([near[:here], among], 1)
                best = np.argsort(-sims, 1, kind="stable")[:, :beam]
                candidates, sims = np.take_along_axis(candidates, best, 1), np.take_along_axis(sims, best, 1)
                candidates = np.where(np.isfinite(sims), candidates, -1).astype(np.int32)
                chosen = _diverse(points, candidates, sims, links)
                lists[k][mine, :links] = chosen
                _link_back(points, place, lists[k], mine, chosen)
            starts = found[:, : min(8, found.shape[1])].astype(np.int32)
        at += size
    back = order
    return Graph(points[np.argsort(back)], [back[m].astype(np.int32) for m in members], [np.where(x >= 0, back[x], -1).astype(np.int32) for x in lists])


def search(graph: Graph, queries: np.ndarray, beam: int = SEARCH_BEAM) -> np.ndarray:
    """The numbers of the points found for each query, nearest first, -1 behind the last."""
    starts = np.full((len(queries), 1), graph.entry, np.int32)
    for k in range(len(graph.members) - 1, -1, -1):
        place = np.full(len(graph.points), -1, np.int32)
        place[graph.members[k]] = np.arange(len(graph.members[k]))
        found, _ = _beam(graph.points, place, graph.links[k], queries, starts, beam if k == 0 else 8)
        starts = found
    return found


# --------------------------------------------------------------------------- shards


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(finite & F.exists("embedding", lambda x: x != 0.0))


@dataclass
class Layout:
    """For each length of vectors the number of its first shard and how many it has; their total."""

    table: DataFrame  # d, first, shards
    total: int

    @classmethod
    def of(cls, candidates: DataFrame, shard_rows: int) -> Layout:
        """One row for each length that occurs: vectors of one length meet no others."""
        counts = candidates.groupBy(F.size("embedding").alias("d")).agg(F.ceil(F.count("*") / shard_rows).alias("shards"))
        table = common.stash(counts.select("d", "shards", (F.sum("shards").over(Window.orderBy("d")) - F.col("shards")).alias("first")), "ann-layout")
        return cls(table, int(table.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0]))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix of doubles."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


_INDEX = "shard int, n bigint, ids binary, groups binary, vectors binary, layers array<struct<members: binary, links: binary>>"


def build_indexes(vectors: DataFrame, layout: Layout, links: int = LINKS, beam: int = BUILD_BEAM) -> DataFrame:
    """usable() -> a row for each shard, in shared storage. Each shard is a task of its own."""

    def one(batch: pa.Table) -> pa.Table:
        ids, matrix = batch.column("vec_id").to_numpy(), _matrix(batch.column("embedding").combine_chunks())
        order = np.argsort(ids, kind="stable")
        ids, matrix = ids[order], matrix[order]
        _, first, group = np.unique(matrix.view(np.dtype((np.void, matrix.strides[0]))).ravel(), return_index=True, return_inverse=True)
        graph = build(extend(matrix[first]), links, beam)
        layers = [{"members": m.tobytes(), "links": x.tobytes()} for m, x in zip(graph.members, graph.links, strict=True)]
        kind = pa.list_(pa.struct([("members", pa.binary()), ("links", pa.binary())]))
        return pa.table({"shard": batch.column("shard").slice(0, 1), "n": pa.array([len(ids)], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "groups": pa.array([group.astype(np.int32).tobytes()], pa.binary()), "vectors": pa.array([matrix.tobytes()], pa.binary()), "layers": pa.array([layers], kind)})

    placed = vectors.join(layout.table, F.size("embedding") == F.col("d"))
    # By id and vector, so that an id with very many vectors is spread as well.
    dealt = placed.select("vec_id", "embedding", (F.col("first") + F.pmod(F.xxhash64("vec_id", "embedding"), F.col("shards"))).cast("int").alias("shard"))
    return common.stash(dealt.repartitionById(max(1, layout.total), "shard").groupBy("shard").applyInArrow(one, _INDEX), "ann-index", codec="uncompressed")


def query_blocks(queries: DataFrame, rows: int = QUERY_BLOCK) -> DataFrame:
    """usable() -> block, d, query_ids, queries: ids and vectors of about `rows` queries of length d as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(d: int):
            ids, matrix = (np.concatenate(x) for x in zip(*held.pop(d), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary())], names=["d", "query_ids", "queries"])

        for batch in batches:
            ids, lists = batch.column("vec_id").to_numpy(), batch.column("embedding")
            lengths = lists.value_lengths().to_numpy()
            for d in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == d)
                for at in range(0, len(mine), rows):
                    some = mine[at : at + rows]
                    held.setdefault(d, []).append((ids[some], _matrix(lists.take(pa.array(some)))))
                    if sum(len(i) for i, _ in held[d]) >= rows:
                        yield block(d)
        for d in list(held):
            yield block(d)

    made = common.map_batches(queries, run, "d int, query_ids binary, queries binary")
    return common.stash(made.withColumn("block", F.monotonically_increasing_id()), "ann-queries", codec="uncompressed")


def search_shards(indexes: DataFrame, blocks: DataFrame, layout: Layout, k: int, beam: int = SEARCH_BEAM, blocks_at_once: int = BLOCKS_AT_ONCE) -> DataFrame:
    """query_id, block, q (which of the block's queries), vec_id, score: the k best of each shard. A task takes one shard and
    about blocks_at_once blocks: it loads the index once for all of them."""
    parts = max(1, -(-blocks.count() // blocks_at_once))
    total = max(1, layout.total * parts)
    work = blocks.join(layout.table, "d").withColumn("shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("shards") - 1)))
    work = work.withColumn("slot", (F.col("shard") * parts + F.pmod(F.xxhash64("block"), F.lit(parts))).cast("int")).select("slot", "block", "query_ids", "queries")
    loaded = indexes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("slot", F.col("shard") * parts + F.col("part")).drop("shard", "part", "n")

    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if index.num_rows and asked.num_rows:
            row = index.to_pylist()[0]
            ids, groups = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["groups"], np.int32)
            matrix = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
            order = np.argsort(groups, kind="stable")  # rows of a point, by id, as rows are by id
            begin = np.searchsorted(groups[order], np.arange(groups.max() + 2))
            members = [np.frombuffer(x["members"], np.int32) for x in row["layers"]]
            graph = Graph(extend(matrix[order[begin[:-1]]]), members, [np.frombuffer(x["links"], np.int32).reshape(len(m), -1) for x, m in zip(row["layers"], members, strict=True)])
            for block, query_ids, data in zip(*(asked.column(c).to_pylist() for c in ("block", "query_ids", "queries")), strict=True):
                queries = np.frombuffer(data, np.float64).reshape(-1, matrix.shape[1])
                out += [(np.full(len(best), qid), np.full(len(best), block), np.full(len(best), q, np.int32), best, scores) for q, qid, best, scores in _best(graph, ids, order, begin, matrix, np.frombuffer(query_ids, np.int64), queries, k, beam)]
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int64, np.float64)]
        return pa.table(dict(zip(("query_id", "block", "q", "vec_id", "score"), map(pa.array, columns), strict=True)))

    pairs = loaded.repartitionById(total, "slot").groupBy("slot").cogroup(work.repartitionById(total, "slot").groupBy("slot"))
    return common.stash(pairs.applyInArrow(run, "query_id bigint, block bigint, q int, vec_id bigint, score double"), "ann-found")


def _best(graph: Graph, ids: np.ndarray, order: np.ndarray, begin: np.ndarray, matrix: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(q, query id, ids, scores) of the k best ids in a shard for each query. order, begin: the rows of each point."""
    extended = np.concatenate([queries, np.zeros((len(queries), 1))], 1).astype(np.float32)
    waiting, width = np.arange(len(queries)), max(beam, k + 1)
    while len(waiting):
        again = []
        for q, near in zip(waiting.tolist(), search(graph, extended[waiting], width), strict=True):
            # The k + 1 least ids of each point are enough: one may be the query's own.
            rows = np.concatenate([order[begin[p] : min(begin[p + 1], begin[p] + k + 1)] for p in near[near >= 0].tolist()])
            rows = rows[ids[rows] != query_ids[q]]
            scores = matrix[rows] @ queries[q]
            best = np.lexsort((ids[rows], -scores))
            best = best[np.sort(np.unique(ids[rows][best], return_index=True)[1])][:k]  # an id by its best vector
            if len(best) < k and width < len(graph.points):
                again.append(q)
            else:
                yield q, int(query_ids[q]), ids[rows][best], scores[best]
        waiting, width = np.array(again, np.int64), 2 * width


def nearest(vectors: DataFrame, is_query, k: int = 20, shard_rows: int = SHARD_ROWS, links: int = LINKS, build_beam: int = BUILD_BEAM, search_beam: int = SEARCH_BEAM, blocks_at_once: int = BLOCKS_AT_ONCE) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of largest inner product found for each row with is_query (a
    Column), the row's own id left out, ties to the smaller vec_id."""
    taking = common.stash(usable(vectors), "ann-vectors")
    candidates = common.stash(taking.distinct(), "ann-candidates")
    layout = Layout.of(candidates, shard_rows)
    indexes = build_indexes(candidates, layout, links, build_beam)
    found = search_shards(indexes, query_blocks(taking.where(is_query)), layout, k, search_beam, blocks_at_once)
    distinct = found.groupBy("query_id", "block", "q", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("block", "q").orderBy(F.desc("score"), "vec_id")
    return distinct.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
