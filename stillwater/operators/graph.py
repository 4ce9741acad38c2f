"""Graph analytics over edges (src, dst, ...), as loops of joins and aggregates over distributed tables.

Components are named by their least state. All loops keep their state in the checkpoint folder round by round. A loop that has
not ended after HASTE rounds takes chains together (chains.py) and goes on with what is left, so long paths do not make as many
rounds as they have states.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillwater.operators.chains import chains
from stillwater.operators.numbering import number, running
from stillwater.operators.storage import Pile, Rounds, divided, keep, measured


#: Rounds after which a loop looks for chains.
HASTE = 6


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("state")).union(edges.select("dst")).distinct()


# --------------------------------------------------------------------------- reachability


def closure(start: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All states that repeated steps reach from start(state), start included. step: states -> next states. Each
    round is one job, and only steps from the states that the last one found."""
    return _closure(start, step, None)[0]


def _closure(start: DataFrame, step: Callable[[DataFrame], DataFrame], most: int | None) -> tuple[DataFrame, bool]:
    """The same in at most so many rounds, and whether it has ended."""
    seen = Pile(start.select("state").distinct())
    frontier = seen.all
    rounds, n = Rounds("the closure"), 0
    while seen.added:
        if n == most:
            return seen.all, False
        rounds.next()
        n += 1
        frontier = seen.add(step(frontier).select("state").distinct().join(seen.all, "state", "left_anti"))
    return seen.all, True


def forward(edges: DataFrame, start: DataFrame) -> DataFrame:
    """All states that edges lead to from start(state), start included."""
    along = lambda e: lambda at: e.join(at, F.col("src") == F.col("state"), "left_semi").select(F.col("dst").alias("state"))
    seen, ended = _closure(start, along(edges), HASTE)
    if ended:
        return seen
    edges = keep(edges.where("src <> dst").select("src", "dst").distinct())
    c = chains(edges)
    if not c.links:
        return closure(seen, along(edges))
    # A chain is left through its tail, and a state on it reaches those behind it.
    inside = keep(c.members.join(seen, "state", "left_semi"))
    outside = forward(c.edges.select("src", "dst"), seen.union(inside.select(F.col("tail").alias("state"))).distinct())
    first = inside.groupBy("chain").agg(F.min("before").alias("first"))
    heads = c.members.join(outside.select(F.col("state").alias("head")), "head", "left_semi").select("state")
    behind = c.members.join(first, "chain").where("before >= first").select("state")
    round_ = c.cycles.join(c.cycles.join(seen, "state", "left_semi").select("least").distinct(), "least", "left_semi").select("state")
    return keep(outside.union(heads).union(behind).union(round_).distinct())


def backward(edges: DataFrame, start: DataFrame) -> DataFrame:
    return forward(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start)


# --------------------------------------------------------------------------- components


def stars(links: DataFrame) -> DataFrame:
    """Links (u, v) -> the links (u, v) of each state that is not its component's least one to that one. Alternating star
    contraction: first larger, then smaller neighbours hang under the least one. A round is one job of three shuffles; the links
    are stars as soon as it changes none, which a digest of all links tells."""
    digest = F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")
    links, seen = measured(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), *digest)
    least = F.min("v").over(Window.partitionBy("u"))
    rounds = Rounds("the contraction")
    while seen["n"]:
        rounds.next()
        both = links.union(links.select("v", "u")).select("u", "v", F.least(least, "u").alias("m"))
        large = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).select("u", "v", least.alias("m"))
        hung = large.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        before = seen
        links, seen = measured(hung.where("u <> v").distinct(), *digest)
        if seen == before:
            break
    return links


def weak_components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """state, wcc."""
    links = stars(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return vertices.join(links, F.col("state") == F.col("u"), "left").select("state", F.coalesce("v", "state").alias("wcc"))


def _inner(edges: DataFrame) -> DataFrame:
    """The edges whose ends both have an edge in and one out."""
    into, out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst")


def trim(edges: DataFrame) -> tuple[DataFrame, int]:
    """edges between states that all have a live edge in and one out, and their number: all cycles, and what lies between
    them. Two steps a job."""
    return _trim(edges, None)[:2]


def _trim(edges: DataFrame, most: int | None) -> tuple[DataFrame, int, bool]:
    live, seen = measured(edges.select("src", "dst"))
    n = seen["n"]
    # Most often nothing goes, which its states tell: then no edges are moved for it.
    ends = live.select(F.col("src").alias("state"), F.lit(True).alias("out")).union(live.select("dst", F.lit(False)))
    if not n or not measured(ends.groupBy("state").agg(F.min("out").alias("a"), F.max("out").alias("b")).where("a = b").select("state"))[1]["n"]:
        return live, n, True
    rounds, k = Rounds("trimming"), 0
    while True:
        rounds.next()
        live, seen = measured(_inner(_inner(live)))
        if seen["n"] == n or not seen["n"]:
            return live, seen["n"], True
        n, k = seen["n"], k + 1
        if k == most:
            return live, n, False


def trim_rounds(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """state, round: in which round each state outside the core goes. A round is one job."""
    left, out, k = vertices.select("state"), [], 0
    none = left.withColumn("round", F.lit(0).cast("long")).limit(0)
    ends = keep(edges.select("src", "dst"))
    while True:
        k += 1
        live = ends.join(left.select(F.col("state").alias("src")), "src", "left_semi").join(left.select(F.col("state").alias("dst")), "dst", "left_semi") if out else ends
        into, onward = (live.select(F.col(c).alias("state")).distinct().withColumn(c, F.lit(True)) for c in ("dst", "src"))
        marked = left.join(into, "state", "left").join(onward, "state", "left").withColumn("round", F.lit(k).cast("long"))
        gone, left, _ = divided(marked.select("state", "round", (F.col("dst").isNull() | F.col("src").isNull()).alias("goes")), F.col("goes"))
        if gone is None:
            return Pile.of(out, none).select("state", "round")
        out.append(gone)
        if left is None:
            return Pile.of(out, none).select("state", "round")
        left = left.select("state")


def two_cycles(edges: DataFrame) -> DataFrame:
    """a < b with edges both ways."""
    e = edges.select("src", "dst").distinct()
    return e.where("src < dst").join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]).select(F.col("src").alias("a"), F.col("dst").alias("b"))


def strong_components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """state, scc. Trim; colour every state with the least state that reaches it; the states of a colour that reach back
    to the state that names it are its component; repeat on what is left of the colours."""
    found = _cyclic(edges.select("src", "dst").where("src <> dst").distinct(), HASTE)
    if found is None:
        return vertices.select("state", F.col("state").alias("scc"))
    return vertices.join(found, "state", "left").select("state", F.coalesce("scc", "state").alias("scc"))


def _cyclic(edges: DataFrame, haste: int | None) -> DataFrame | None:
    """state, scc of the states on cycles; None if there are none."""
    live, n, ended = _trim(edges, haste)
    if not ended:
        return _through_chains(live)
    found: Pile | None = None
    rounds = Rounds("the decomposition")
    while n:
        rounds.next()
        colour = _least_reaching(live, haste)
        if colour is None:
            more = _through_chains(live)
            return found.all.unionByName(more) if found else more
        same = live.join(colour.withColumnRenamed("state", "src"), "src").join(colour.select(F.col("state").alias("dst"), F.col("colour").alias("c2")), "dst").where("colour = c2")
        same = keep(same.select("src", "dst", "colour"))
        members = backward(same, colour.where("state = colour").select("state"))
        # The naming state reaches its whole component and is the least that does, so it is the component's least.
        done = members.join(colour, "state").select("state", F.col("colour").alias("scc"))
        if found is None:
            found = Pile(done)
            done = found.all
        else:
            done = found.add(done)
        left = same.join(done.select(F.col("state").alias("src")), "src", "left_anti").join(done.select(F.col("state").alias("dst")), "dst", "left_anti")
        live, n, ended = _trim(left.select("src", "dst"), haste)
        if not ended:
            more = _through_chains(live)
            return found.all.unionByName(more) if more is not None else found.all
    return found.all if found else None


def _through_chains(live: DataFrame) -> DataFrame | None:
    """_cyclic() of what is left when chains are taken together. A chain lies in a component if both of its ends do, in the same."""
    c = chains(live)
    if not c.links:
        return _cyclic(live, None)
    inner = _cyclic(c.edges.where("src <> dst").select("src", "dst"), HASTE)
    none = live.select(F.col("src").alias("state"), F.col("src").alias("scc")).limit(0)
    loops = c.edges.where("src = dst").select(F.col("src").alias("state"), F.col("src").alias("scc"))
    inner = keep((inner if inner is not None else none).unionByName(loops).groupBy("state").agg(F.min("scc").alias("scc")))
    ends = c.members.join(inner.select(F.col("state").alias("head"), "scc"), "head").join(inner.select(F.col("state").alias("tail"), F.col("scc").alias("other")), "tail")
    whole = keep(inner.unionByName(ends.where("scc = other").select("state", "scc")).unionByName(c.cycles.select("state", F.col("least").alias("scc"))))
    least = whole.groupBy("scc").agg(F.min("state").alias("name"))  # links may have lesser names than their ends
    return keep(whole.join(least, "scc").select("state", F.col("name").alias("scc")))


def _least_reaching(edges: DataFrame, most: int | None = None) -> DataFrame | None:
    """state, colour: the least state that reaches each state, itself included; None if that takes more than `most` rounds. A
    round is one job of two steps along edges from the states that got another colour in the last one."""
    colour = keep(vertices_of(edges).select("state", F.col("state").alias("colour")))
    moved = colour
    rounds, k = Rounds("colouring"), 0
    while True:
        rounds.next()
        if k == most:
            return None
        k += 1
        one = edges.join(moved, F.col("src") == F.col("state")).groupBy(F.col("dst").alias("state")).agg(F.min("colour").alias("colour"))
        two = edges.join(one, F.col("src") == F.col("state")).select(F.col("dst").alias("state"), "colour")
        offers = one.union(two).groupBy(F.col("state").alias("to")).agg(F.min("colour").alias("offer"))
        both = colour.join(offers, F.col("state") == F.col("to"), "left")
        new, seen = measured(
            both.select("state", F.least("colour", F.coalesce("offer", "colour")).alias("colour"), F.coalesce(F.col("offer") < F.col("colour"), F.lit(False)).alias("moved")),
            F.count_if("moved").alias("moved"),
        )
        colour, moved = new.select("state", "colour"), new.where("moved").select("state", "colour")
        if not seen["moved"]:
            return colour


# --------------------------------------------------------------------------- condensation


def condense(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """src, dst: distinct edges between components."""
    one = edges.join(scc.select(F.col("state").alias("src"), F.col("scc").alias("a")), "src").join(scc.select(F.col("state").alias("dst"), F.col("scc").alias("b")), "dst")
    return one.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def levels(condensed: DataFrame, components: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """scc, level: 1 for components without edges out, else one more than the highest level among their successors. base: (scc,
    base), levels that components have at least because of successors that are not among these."""
    edges = condensed.select("src", "dst", F.lit(1).cast("long").alias("length"))
    nodes = components.select("scc").distinct()
    if base is None:
        nodes = nodes.withColumn("base", F.lit(1).cast("long"))
    else:
        nodes = nodes.join(base, "scc", "left").select("scc", F.coalesce("base", F.lit(1)).cast("long").alias("base"))
    return _longest(edges, nodes.withColumnRenamed("scc", "state"), HASTE).select(F.col("state").alias("scc"), "level")


def _longest(edges: DataFrame, nodes: DataFrame, haste: int | None) -> DataFrame:
    """(src, dst, length) without cycles and (state, base) -> state, level: the greatest of base and of length + level over the
    state's edges. A round is one job: what the last round placed frees those that waited for nothing else, and raises their
    base. After `haste` rounds chains of those that still wait are taken together."""
    edges = keep(edges)
    waits = edges.groupBy(F.col("src").alias("state")).agg(F.count("*").alias("waits"))
    open_ = nodes.join(waits, "state", "left").select("state", "base", F.coalesce("waits", F.lit(0)).alias("waits"))
    none, out, k = open_.limit(0), [], 0
    placed = lambda: Pile.of(out, none).select("state", F.col("base").alias("level"))
    rounds = Rounds("the levels")
    while True:
        rounds.next()
        last, open_, _ = divided(open_, F.col("waits") == 0)
        if last is None and open_ is not None:
            raise ValueError("the components have a cycle")
        out += [last] if last is not None else []
        if open_ is None:
            return placed()
        freed = edges.join(last.select(F.col("state").alias("dst"), F.col("base").alias("level")), "dst").groupBy(F.col("src").alias("state")).agg(F.count("*").alias("freed"), F.max(F.col("level") + F.col("length")).alias("rise"))
        open_ = open_.join(freed, "state", "left").select("state", F.greatest("base", F.coalesce("rise", F.col("base"))).alias("base"), (F.col("waits") - F.coalesce("freed", F.lit(0))).alias("waits"))
        k += 1
        if k == haste:
            open_ = keep(open_)
            names = open_.select("state")
            inside = edges.join(names.withColumnRenamed("state", "src"), "src", "left_semi").join(names.withColumnRenamed("state", "dst"), "dst", "left_semi")
            return keep(placed().unionByName(_longest_through_chains(keep(inside), open_.select("state", "base"))))


def _longest_through_chains(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    c = chains(edges, nodes.select("state", F.col("base").alias("value")))
    if not c.links:
        return _longest(edges, nodes, None)
    # A chain's head gets what its links have of their own, its edge what lies behind the chain.
    first = edges.join(c.members.select(F.col("state").alias("dst"), "head", "most"), "dst").where("src = head")  # its first link
    rise = first.groupBy(F.col("src").alias("state")).agg(F.max(F.col("most") + F.col("length")).alias("rise"))
    others = nodes.join(c.members.select("state"), "state", "left_anti").join(rise, "state", "left").select("state", F.greatest("base", F.coalesce("rise", F.col("base"))).alias("base"))
    level = keep(_longest(c.edges, others, HASTE))
    behind = c.members.join(level.select(F.col("state").alias("tail"), "level"), "tail")
    return level.unionByName(behind.select("state", F.greatest("most", F.col("after") + F.col("level")).alias("level")))


def terminals(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """scc: components that no edge leaves."""
    return scc.select("scc").distinct().join(condense(edges, scc).select(F.col("src").alias("scc")), "scc", "left_anti")


def component_sizes(scc: DataFrame) -> DataFrame:
    """scc, size, number (from 0, by scc), begin: where its states stand when all are sorted by component."""
    sizes = scc.groupBy("scc").agg(F.count("*").alias("size")).withColumn("one", F.lit(1).cast("long"))
    return running(sizes, ["scc"], {"number": "one", "begin": "size"}).drop("one")


def trimmed_and_cyclic(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """kind, states: how many states trimming removes, how many lie between cycles, in two-cycles' and in larger components."""
    live, _ = trim(edges.where("src <> dst").select("src", "dst").distinct())
    core = vertices_of(live).withColumn("in_core", F.lit(True))
    sizes = scc.groupBy("scc").agg(F.count("*").alias("size"))
    kind = F.when(F.col("size") > 2, "larger component").when(F.col("size") == 2, "component of two").when(F.col("in_core"), "between cycles").otherwise("trimmed")
    return scc.join(sizes, "scc").join(core, "state", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("states"))


def size_histogram(scc: DataFrame, most: int = 9) -> DataFrame:
    """size, components: the largest sizes and how many components have each."""
    return scc.groupBy("scc").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("components")).orderBy(F.desc("size")).limit(most)


def vertex_order(scc: DataFrame, level: DataFrame) -> DataFrame:
    """state, ord: terminal components first, then from the sources down; inside by component, then state."""
    keyed = scc.join(level, "scc").select("state", "scc", F.when(F.col("level") == 1, F.lit(0)).otherwise(1).alias("t"), (-F.col("level")).alias("l"))
    return number(keyed, ["t", "l", "scc", "state"], "ord").select("state", "ord")
