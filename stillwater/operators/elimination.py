"""Chains of any size solved by elimination: states are censored out and put back, without any subtraction, so every value is
right to many digits whatever the rates (Grassmann, Taksar and Heyman 1985; Alfa, Xue and Ye 2002).

Leaving out a state k adds rate(i, k) * rate(k, j) / out(k) to each rate(i, j), out(k) being all that leaves k. States that
are no neighbours of each other can go at once: each round picks, by joins and aggregates over the edges, the states whose
in- times out-degree is at most FILL and the least among their neighbours, so rows do not multiply. What is left, a core, is
cut into blocks of states, and blocks are eliminated by the same rule, all blocks of a round at once: a block's inverse is one
task, and its products with the rates into and out of it are one task for each pair of blocks. The last block of each chain
is solved as it stands.

An Elimination keeps what each round left out. It gives stationary distributions, and solves for any number of right sides:
forward() through the rounds, backward() in reverse.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.operators.numbering import number
from stillwater.operators.storage import Rounds, keep, measured

#: In-degree times out-degree up to which a single state is eliminated by joins.
FILL = 64
#: Rounds on single states go on while they take at least this share of the states left.
SHARE = 0.03
#: Bytes of blocks in a file of a stored table.
FILE = 48 << 20
#: Below this size the loops over states take less time than products of halves.
SMALL = 48


# --------------------------------------------------------------------------- inside a task


def inverse(rates: np.ndarray, out: np.ndarray) -> np.ndarray:
    """(D - rates)^-1, D being what leaves each state: its rates to the others, and out. The diagonal of rates does not count.
    Only sums, products and quotients of numbers that are not negative."""
    n = len(rates)
    if n <= SMALL:
        a, e = rates.astype(float), out.astype(float).copy()
        np.fill_diagonal(a, 0.0)
        right = np.eye(n)
        pivot = np.empty(n)
        for k in range(n):
            pivot[k] = a[k, k + 1 :].sum() + e[k]
            share = a[k + 1 :, k] / pivot[k]
            a[k + 1 :, k + 1 :] += np.outer(share, a[k, k + 1 :])
            e[k + 1 :] += share * e[k]
            right[k + 1 :] += np.outer(share, right[k])
        for k in range(n - 1, -1, -1):
            right[k] = (right[k] + a[k, k + 1 :] @ right[k + 1 :]) / pivot[k]
        return right
    h = n // 2
    first = inverse(rates[:h, :h], out[:h] + rates[:h, h:].sum(1))
    left = rates[h:, :h] @ first
    second = inverse(rates[h:, h:] + left @ rates[:h, h:], out[h:] + left @ out[:h])
    across = first @ (rates[:h, h:] @ second)
    made = np.empty((n, n))
    made[:h, :h], made[:h, h:], made[h:, :h], made[h:, h:] = first + across @ left, across, second @ left, second
    return made


def stationary(rates: np.ndarray) -> np.ndarray:
    """The stationary distribution of a strongly connected chain with rates[source, target]; its greatest value is 1."""
    n = len(rates)
    if n <= SMALL:
        a = rates.astype(float)
        np.fill_diagonal(a, 0.0)
        for k in range(n - 1, 0, -1):
            a[:k, k] /= a[k, :k].sum()
            a[:k, :k] += np.outer(a[:k, k], a[k, :k])
        x = np.ones(n)
        for k in range(1, n):
            x[k] = x[:k] @ a[:k, k]
        return x / x.max()
    h = n // 2
    back = rates[h:, :h] @ inverse(rates[:h, :h], rates[:h, h:].sum(1))
    second = stationary(rates[h:, h:] + back @ rates[:h, h:])
    x = np.append(second @ back, second)
    return x / x.max()


def _square(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data).reshape(rows, -1)


# --------------------------------------------------------------------------- independent sets


def independent(edges: DataFrame, cost: DataFrame) -> DataFrame:
    """own, state of the states in cost (own, state, cost) that cost less than their neighbours along edges (own, src, dst) that
    are in it too; ties by a hash."""
    rank = F.struct("cost", F.xxhash64("state").alias("h"), "state")
    ranked = cost.select("own", "state", rank.alias("rank"))
    pairs = edges.select("own", "src", "dst").union(edges.select("own", F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst")
    near = pairs.join(ranked.select("own", F.col("state").alias("dst"), "rank"), ["own", "dst"]).groupBy("own", F.col("src").alias("state")).agg(F.min("rank").alias("least"))
    return ranked.join(near, ["own", "state"], "left").where(F.col("least").isNull() | (F.col("rank") < F.col("least"))).select("own", "state")


def _summed(df: DataFrame, *by: str, value: str = "value") -> DataFrame:
    return df.groupBy(*by).agg(F.sum(value).alias(value))


@dataclass
class Round:
    """What a round took out. Of states: pivots (own, k, out), into (own, i, k, rate), away (own, k, j, rate), all of this round.
    Of blocks: pivots (own, k, n, data: the inverse), and the same with matrices as data."""

    pivots: DataFrame
    into: DataFrame
    away: DataFrame


@dataclass
class Elimination:
    """Chains by name (own), eliminated."""

    rounds: list[Round] = field(default_factory=list)
    block_rounds: list[Round] = field(default_factory=list)
    places: DataFrame | None = None  # own, state, block, at (place in the block), n (states of the block)
    last: DataFrame | None = None  # own, block, n, data: the last block's rates, and what leaves it to the outside
    most: int = 0  # blocks in a file

    # ----------------------------------------------------------------- building

    @classmethod
    def of(cls, links: DataFrame, leaks: DataFrame, dense: int) -> Elimination:
        """links: (own, src, dst, rate) of strongly connected chains; leaks: (own, state, rate) out of a chain. dense: states
        that one task takes as a block; blocks of larger cores have half as many."""
        made = cls()
        links = keep(links.where("src <> dst").select("own", "src", "dst", "rate"))
        leaks = keep(leaks.groupBy("own", "state").agg(F.sum("rate").alias("leak")))
        known = keep(links.select("own", F.col("src").alias("state")).union(links.select("own", "dst")).union(leaks.select("own", "state")).distinct())
        links, leaks, known = made._eliminate_states(links, leaks, known, dense)
        made._eliminate_blocks(links, leaks, known, dense)
        return made

    def _eliminate_states(self, links: DataFrame, leaks: DataFrame, known: DataFrame, dense: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        rounds = Rounds("elimination of states")
        while True:
            rounds.next()
            big = known.groupBy("own").agg(F.count("*").alias("n")).where(F.col("n") > dense)
            away = links.groupBy("own", F.col("src").alias("state")).agg(F.count("*").alias("away"), F.sum("rate").alias("out"))
            into = links.groupBy("own", F.col("dst").alias("state")).agg(F.count("*").alias("into"))
            cost = away.join(into, ["own", "state"]).join(big, "own").withColumn("cost", F.col("away") * F.col("into"))
            cost, seen = measured(cost.select("own", "state", "out", "cost"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("cost") <= FILL).alias("cheap"))
            if not seen["n"] or seen["cheap"] < SHARE * seen["n"]:
                return links, leaks, known
            chosen = independent(links, cost.where(F.col("cost") <= FILL))
            pivots = chosen.join(cost, ["own", "state"]).join(leaks, ["own", "state"], "left")
            pivots, taken = measured(pivots.select("own", F.col("state").alias("k"), (F.col("out") + F.coalesce("leak", F.lit(0.0))).alias("out"), F.coalesce("leak", F.lit(0.0)).alias("leak")))
            gone = pivots.select("own", "k")
            mark_src, mark_dst = gone.select("own", F.col("k").alias("src"), F.lit(True).alias("s")), gone.select("own", F.col("k").alias("dst"), F.lit(True).alias("d"))
            kind = F.when(F.col("s"), "away").when(F.col("d"), "into").otherwise("rest")
            marked = keep(links.join(mark_src, ["own", "src"], "left").join(mark_dst, ["own", "dst"], "left").select("own", "src", "dst", "rate", kind.alias("kind")))
            into = marked.where("kind = 'into'").select("own", F.col("src").alias("i"), F.col("dst").alias("k"), "rate")
            away = marked.where("kind = 'away'").select("own", F.col("src").alias("k"), F.col("dst").alias("j"), "rate")
            self.rounds.append(Round(pivots, into, away))
            share = into.join(pivots, ["own", "k"]).withColumn("rate", F.col("rate") / F.col("out"))
            fill = share.select("own", "i", "k", "rate").join(away.withColumnRenamed("rate", "r"), ["own", "k"]).where("i <> j")
            rest = marked.where("kind = 'rest'").select("own", "src", "dst", "rate")
            links = keep(_summed(rest.union(fill.select("own", F.col("i").alias("src"), F.col("j").alias("dst"), F.col("rate") * F.col("r"))), "own", "src", "dst", value="rate"))
            left = leaks.join(gone.withColumnRenamed("k", "state"), ["own", "state"], "left_anti")
            more = share.where("leak > 0").select("own", F.col("i").alias("state"), (F.col("rate") * F.col("leak")).alias("leak"))
            leaks = keep(_summed(left.union(more), "own", "state", value="leak"))
            known = keep(known.join(gone.withColumnRenamed("k", "state"), ["own", "state"], "left_anti"))
            if taken["n"] < SHARE * seen["n"]:
                return links, leaks, known

    def _eliminate_blocks(self, links: DataFrame, leaks: DataFrame, known: DataFrame, dense: int) -> None:
        half = max(1, dense // 2)
        self.most = max(1, FILE // (8 * half * half))
        sizes = known.groupBy("own").agg(F.count("*").alias("size"))
        size = F.when(F.col("size") <= dense, F.lit(dense)).otherwise(F.lit(half))
        placed = keep(number(known, ["state"], "i", by=["own"])).join(sizes, "own").select("own", "state", F.floor(F.col("i") / size).cast("long").alias("block"), F.pmod("i", size).cast("int").alias("at"))
        counts = placed.groupBy("own", "block").agg(F.count("*").cast("int").alias("n"))
        self.places = places = keep(placed.join(counts, ["own", "block"]))
        one = places.select("own", F.col("state").alias("src"), F.col("block").alias("i"), F.col("at").alias("row"), F.col("n").alias("n"))
        two = places.select("own", F.col("state").alias("dst"), F.col("block").alias("j"), F.col("at").alias("col"), F.col("n").alias("m"))

        def matrix(key, pdf):
            import pandas as pd

            made = np.zeros((int(pdf["n"].iloc[0]), int(pdf["m"].iloc[0])))
            np.add.at(made, (pdf["row"].to_numpy(), pdf["col"].to_numpy()), pdf["rate"].to_numpy())
            return pd.DataFrame({"own": [key[0]], "i": [key[1]], "j": [key[2]], "n": [made.shape[0]], "data": [made.tobytes()]})

        blocks = links.join(one, ["own", "src"]).join(two, ["own", "dst"]).select("own", "i", "j", "row", "col", "n", "m", "rate")
        blocks = keep(blocks.groupBy("own", "i", "j").applyInPandas(matrix, _BLOCKS), most=self.most)
        out = places.join(leaks, ["own", "state"], "left").select("own", "block", "n", "at", F.coalesce("leak", F.lit(0.0)).alias("value"))
        out = keep(_vectors(out.withColumn("col", F.lit(0).cast("long"))))
        left = counts
        rounds = Rounds("elimination of blocks")
        while True:
            rounds.next()
            left, seen = measured(left.join(left.groupBy("own").agg(F.count("*").alias("blocks")), "own").select("own", "block", "n", "blocks"), F.count_if(F.col("blocks") > 1).alias("open"))
            if not seen["open"]:
                break
            degree = blocks.where("i <> j").groupBy("own", F.col("i").alias("state")).agg(F.count("*").alias("cost"))
            cost = left.where("blocks > 1").select("own", F.col("block").alias("state")).join(degree, ["own", "state"], "left").na.fill(0, ["cost"])
            gone = keep(independent(blocks.where("i <> j").select("own", F.col("i").alias("src"), F.col("j").alias("dst")), cost).select("own", F.col("state").alias("k")))
            blocks, out = self._take_blocks(blocks, out, left, gone)
            left = left.join(gone.withColumnRenamed("k", "block"), ["own", "block"], "left_anti").drop("blocks")
        self.last = self._with_out(left.select("own", F.col("block").alias("k"), "n"), blocks, out)

    def _with_out(self, chosen: DataFrame, blocks: DataFrame, out: DataFrame) -> DataFrame:
        """own, k, n, data (rates inside a block), out (what leaves each of its states to other blocks and to the outside)."""

        def sums(frames):
            import pandas as pd

            for pdf in frames:
                data = [_square(d, n).sum(1).tobytes() for d, n in zip(pdf["data"], pdf["n"], strict=True)]
                yield pd.DataFrame({"own": pdf["own"], "k": pdf["i"], "n": pdf["n"], "kind": 1, "data": data})

        def join(key, pdf):
            import pandas as pd

            n = int(pdf["n"].iloc[0])
            inside, leaving = np.zeros((n, n)), np.zeros(n)
            for kind, data in zip(pdf["kind"], pdf["data"], strict=True):
                if kind == 0:
                    inside = inside + _square(data, n)
                elif kind == 1:
                    leaving = leaving + np.frombuffer(data)
            return pd.DataFrame({"own": [key[0]], "k": [key[1]], "n": [n], "data": [inside.tobytes()], "out": [leaving.tobytes()]})

        mine = chosen.select("own", "k")
        inner = blocks.where("i = j").join(mine.withColumnRenamed("k", "i"), ["own", "i"], "left_semi").select("own", F.col("i").alias("k"), "n", F.lit(0).alias("kind"), "data")
        outer = blocks.where("i <> j").join(mine.withColumnRenamed("k", "i"), ["own", "i"], "left_semi").select("own", "i", "n", "data").mapInPandas(sums, "own bigint, k bigint, n int, kind int, data binary")
        lost = out.join(mine.withColumnRenamed("k", "block"), ["own", "block"], "left_semi").select("own", F.col("block").alias("k"), "n", F.lit(1).alias("kind"), "data")
        none = chosen.select("own", "k", "n", F.lit(2).alias("kind"), F.lit(b"").alias("data"))
        return keep(inner.unionByName(outer).unionByName(lost).unionByName(none).groupBy("own", "k").applyInPandas(join, "own bigint, k bigint, n int, data binary, out binary"), most=self.most)

    def _take_blocks(self, blocks: DataFrame, out: DataFrame, left: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
        def inverses(frames):
            import pandas as pd

            for pdf in frames:
                data = [inverse(_square(d, n), np.frombuffer(o)).tobytes() for d, o, n in zip(pdf["data"], pdf["out"], pdf["n"], strict=True)]
                yield pd.DataFrame({"own": pdf["own"], "k": pdf["k"], "n": pdf["n"], "data": data})

        chosen = gone.join(left.select("own", F.col("block").alias("k"), "n"), ["own", "k"])
        pivots = keep(self._with_out(chosen, blocks, out).mapInPandas(inverses, "own bigint, k bigint, n int, data binary"), most=self.most)
        marks = gone.select("own", F.col("k").alias("i"), F.lit(True).alias("s")), gone.select("own", F.col("k").alias("j"), F.lit(True).alias("d"))
        kind = F.when(F.col("s") & F.col("d"), "self").when(F.col("s"), "away").when(F.col("d"), "into").otherwise("rest")
        marked = keep(blocks.join(marks[0], ["own", "i"], "left").join(marks[1], ["own", "j"], "left").select("own", "i", "j", "n", "data", kind.alias("kind")), most=self.most)
        into = marked.where("kind = 'into'").select("own", "i", F.col("j").alias("k"), "n", "data")
        away = marked.where("kind = 'away'").select("own", F.col("i").alias("k"), "j", "n", "data")
        self.block_rounds.append(Round(pivots, into, away))
        back = keep(_products(into, pivots.select("own", "k", F.col("n").alias("m"), F.col("data").alias("right")), "own bigint, i bigint, k bigint, n int, data binary", ["own", "k"], ["own", "i", "k", "n"]), most=self.most)
        fill = _products(back, away.select("own", "k", "j", F.col("n").alias("m"), F.col("data").alias("right")), "own bigint, i bigint, j bigint, n int, data binary", ["own", "k"], ["own", "i", "j", "n"])
        rest = marked.where("kind = 'rest'").select("own", "i", "j", "n", "data")
        new = keep(_added(rest.unionByName(fill), ["own", "i", "j"], _BLOCKS), most=self.most)
        lost = out.join(gone.withColumnRenamed("k", "block"), ["own", "block"])
        more = _applied(back.select("own", F.col("i").alias("to"), F.col("k").alias("block"), "n", "data"), lost, left_side=True)
        kept = out.join(gone.withColumnRenamed("k", "block"), ["own", "block"], "left_anti")
        return new, keep(_added(kept.unionByName(more), ["own", "block", "col"], _VECTORS))

    # ----------------------------------------------------------------- results

    def stationary(self) -> DataFrame:
        """own, state, p of chains without leaks, each summing up to 1."""

        def solve(frames):
            import pandas as pd

            for pdf in frames:
                data = [stationary(_square(d, n)).tobytes() for d, n in zip(pdf["data"], pdf["n"], strict=True)]
                yield pd.DataFrame({"own": pdf["own"], "block": pdf["k"], "col": 0, "n": pdf["n"], "data": data})

        x = keep(self.last.select("own", "k", "n", "data").mapInPandas(solve, _VECTORS))
        p = keep(self._backward(x, None, None, transposed=True).drop("col"))
        return p.join(p.groupBy("own").agg(F.sum("value").alias("sum")), "own").select("own", "state", (F.col("value") / F.col("sum")).alias("p"))

    def log_determinants(self) -> DataFrame:
        """own, log: the logarithm of the determinant of D - rates, D being all that leaves each state: the sum over all that was
        left out, each by its pivot or block. -infinity where nothing leaves a chain."""

        def logs(invert: bool):
            def run(frames):
                import pandas as pd

                for pdf in frames:
                    out = []
                    for i, n in enumerate(pdf["n"]):
                        with np.errstate(divide="ignore", invalid="ignore"):
                            w = inverse(_square(pdf["data"].iloc[i], n), np.frombuffer(pdf["out"].iloc[i])) if invert else _square(pdf["data"].iloc[i], n)
                        out.append(-np.linalg.slogdet(w)[1] if np.isfinite(w).all() else -np.inf)
                    yield pd.DataFrame({"own": pdf["own"], "log": np.array(out, float)})

            return run

        parts = [self.last.mapInPandas(logs(True), "own bigint, log double")]
        parts += [r.pivots.select("own", F.log("out").alias("log")) for r in self.rounds]
        parts += [r.pivots.mapInPandas(logs(False), "own bigint, log double") for r in self.block_rounds]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.groupBy("own").agg(F.sum("log").alias("log"))

    def solve(self, right: DataFrame, transposed: bool) -> DataFrame:
        """right: (own, state, col, value), never negative -> own, state, col, value: x with x D = right + x rates if transposed,
        else D x = right + rates x, D being all that leaves each state. Only columns that occur in a chain, and only its states
        with a value above 0."""
        states, blocks, sides = self._forward(right, transposed)

        def last(frames):
            import pandas as pd

            for pdf in frames:
                w = [inverse(_square(d, n), np.frombuffer(o)).tobytes() for d, o, n in zip(pdf["data"], pdf["out"], pdf["n"], strict=True)]
                yield pd.DataFrame({"own": pdf["own"], "to": pdf["k"], "block": pdf["k"], "n": pdf["n"], "data": w})

        tail = self.last.mapInPandas(last, "own bigint, to bigint, block bigint, n int, data binary")
        x = keep(_applied(tail, blocks, left_side=not transposed))
        return self._backward(x, states, sides, transposed).where("value > 0")

    def _forward(self, right: DataFrame, transposed: bool) -> tuple[list[DataFrame], DataFrame, list[DataFrame]]:
        """The right sides that states and blocks have when they go: of each round on states, of the last blocks, of each round
        on blocks."""
        v = keep(_summed(right.select("own", "state", "col", "value"), "own", "state", "col"))
        went = []
        for r in self.rounds:
            mine = keep(v.join(r.pivots.select("own", F.col("k").alias("state"), "out"), ["own", "state"]))
            went.append(mine.drop("out"))
            share = mine.select("own", F.col("state").alias("k"), "col", (F.col("value") / F.col("out")).alias("value"))
            ways = r.away.withColumnRenamed("j", "state") if transposed else r.into.withColumnRenamed("i", "state")
            more = share.join(ways, ["own", "k"]).select("own", "state", "col", F.col("value") * F.col("rate"))
            v = keep(_summed(v.join(r.pivots.select("own", F.col("k").alias("state")), ["own", "state"], "left_anti").union(more), "own", "state", "col"))
        b = keep(_vectors(v.join(self.places, ["own", "state"]).select("own", "block", "n", "at", "col", "value")))
        sides = []
        for r in self.block_rounds:
            gone = r.pivots.select("own", F.col("k").alias("block"))
            mine = keep(b.join(gone, ["own", "block"], "left_semi"))
            sides.append(mine)
            inner = keep(_applied(r.pivots.select("own", F.col("k").alias("to"), F.col("k").alias("block"), "n", "data"), mine, left_side=not transposed))
            ways = r.away.select("own", F.col("j").alias("to"), F.col("k").alias("block"), "n", "data") if transposed else r.into.select("own", F.col("i").alias("to"), F.col("k").alias("block"), "n", "data")
            more = _applied(ways, inner, left_side=not transposed)
            b = keep(_added(b.join(gone, ["own", "block"], "left_anti").unionByName(more), ["own", "block", "col"], _VECTORS))
        return went, b, sides

    def _backward(self, x: DataFrame, states: list[DataFrame] | None, sides: list[DataFrame] | None, transposed: bool) -> DataFrame:
        """own, state, col, value of all states, from the last blocks' values."""
        for s in range(len(self.block_rounds) - 1, -1, -1):
            r = self.block_rounds[s]
            ways = r.into.select("own", F.col("k").alias("to"), F.col("i").alias("block"), "n", "data") if transposed else r.away.select("own", F.col("k").alias("to"), F.col("j").alias("block"), "n", "data")
            met = _applied(ways, x, left_side=not transposed)
            met = _added(met.unionByName(sides[s]) if sides else met, ["own", "block", "col"], _VECTORS)
            new = _applied(r.pivots.select("own", F.col("k").alias("to"), F.col("k").alias("block"), "n", "data"), met, left_side=not transposed)
            x = keep(x.unionByName(new))
        value = x.mapInPandas(_spread, "own bigint, block bigint, at int, col bigint, value double")
        v = keep(value.join(self.places.select("own", "block", "at", "state"), ["own", "block", "at"]).select("own", "state", "col", "value"))
        for s in range(len(self.rounds) - 1, -1, -1):
            r = self.rounds[s]
            ways = r.into.withColumnRenamed("i", "state") if transposed else r.away.withColumnRenamed("j", "state")
            met = v.join(ways, ["own", "state"]).select("own", F.col("k").alias("state"), "col", (F.col("value") * F.col("rate")).alias("value"))
            met = _summed(met.unionByName(states[s]) if states else met, "own", "state", "col")
            new = met.join(r.pivots.select("own", F.col("k").alias("state"), "out"), ["own", "state"]).select("own", "state", "col", (F.col("value") / F.col("out")).alias("value"))
            v = keep(v.unionByName(new))
        return v


# --------------------------------------------------------------------------- matrices and vectors as rows

_BLOCKS = "own bigint, i bigint, j bigint, n int, data binary"
_VECTORS = "own bigint, block bigint, col bigint, n int, data binary"


def _vectors(values: DataFrame) -> DataFrame:
    """(own, block, n, at, col, value) -> a row for each block and column."""

    def make(key, pdf):
        import pandas as pd

        made = np.zeros(int(pdf["n"].iloc[0]))
        made[pdf["at"].to_numpy()] = pdf["value"].to_numpy()
        return pd.DataFrame({"own": [key[0]], "block": [key[1]], "col": [key[2]], "n": [len(made)], "data": [made.tobytes()]})

    return values.groupBy("own", "block", "col").applyInPandas(make, _VECTORS)


def _spread(frames):
    import pandas as pd

    for pdf in frames:
        n = pdf["n"].to_numpy()
        yield pd.DataFrame({"own": np.repeat(pdf["own"].to_numpy(), n), "block": np.repeat(pdf["block"].to_numpy(), n), "at": np.concatenate([np.arange(k) for k in n] or [n]), "col": np.repeat(pdf["col"].to_numpy(), n), "value": np.concatenate([np.frombuffer(d) for d in pdf["data"]] or [np.zeros(0)])})


def _products(left: DataFrame, right: DataFrame, schema: str, on: list[str], kept: list[str]) -> DataFrame:
    """data @ right of the rows that meet; left rows have n rows, right ones m."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            data = [(_square(a, n) @ _square(b, m)).tobytes() for a, n, b, m in zip(pdf["data"], pdf["n"], pdf["right"], pdf["m"], strict=True)]
            yield pd.DataFrame({**{c: pdf[c] for c in kept}, "data": data})

    return left.join(right.hint("merge"), on).select(*kept, "m", "data", "right").mapInPandas(run, schema)


def _applied(matrices: DataFrame, vectors: DataFrame, left_side: bool) -> DataFrame:
    """matrices (own, to, block, n, data) by vectors of their block -> vectors of `to`: matrix @ x, or x @ matrix."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for a, n, x in zip(pdf["data"], pdf["n"], pdf["x"], strict=True):
                a, x = _square(a, n), np.frombuffer(x)
                out.append(a @ x if left_side else x @ a)
            yield pd.DataFrame({"own": pdf["own"], "block": pdf["to"], "col": pdf["col"], "n": [len(y) for y in out], "data": [y.tobytes() for y in out]})

    met = matrices.join(vectors.select("own", "block", "col", F.col("data").alias("x")), ["own", "block"])
    return met.select("own", "to", "col", "n", "data", "x").mapInPandas(run, _VECTORS)


def _added(rows: DataFrame, by: list[str], schema: str) -> DataFrame:
    """Matrices or vectors of one place, summed up."""

    def run(key, pdf):
        import pandas as pd

        data = np.frombuffer(pdf["data"].iloc[0])
        for more in pdf["data"].iloc[1:]:
            data = data + np.frombuffer(more)
        return pd.DataFrame({**{c: [k] for c, k in zip(by, key, strict=True)}, "n": [pdf["n"].iloc[0]], "data": [data.tobytes()]})

    return rows.groupBy(*by).applyInPandas(run, schema)
