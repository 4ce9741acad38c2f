"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time 0..1, a straight line from a start to an end multiplier
with area 1, times its target number of words. The integral of the schedule is the source's cumulative demand;
its inverse gives the time at which the source's x-th word is due. A source's documents follow one another, in an
order drawn from a digest of their rows, and begin anew when all have had their turn. A copy's middle word has a
number in this sequence; the inverse at that number is the copy's training position. Where the demand ends before
it, the copy has none and is not taken. Range-sorting by position gives the training order.

Word numbers, places of sources, the filling of sources and ranks in the training order are running sums over
range-partitioned tables: no source, and not the list of all sources, meets in one task.

Defined cases: a null text has 0 words; a null source is a source, last in order; repeated rows, repeated and
null ids each count as a document of their own; a document of 0 words is taken like others of its place in the order,
and once where its source has no words at all; an empty table gives an empty table; other columns are not read by
plan() and come through mix() whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwater.llm import common
from stillwater.operators.numbering import number, running

WEIGHTS = (5.0, 2.0, 1.0)
#: Start and end multipliers of the schedules, by the source's place in order, repeating; each pair's mean is 1.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
SHARE, MOST_PASSES = 1.5, 2.0
SALTS = 32


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(common.WORD)), F.lit(0)).cast("long")


def _cycle(values, place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (place % len(values) + 1).cast("int"))


def source_targets(per_source: DataFrame, weights=WEIGHTS, share: float = SHARE, most_passes: float = MOST_PASSES) -> DataFrame:
    """source, source_size -> and place, weight, target, base: shares by weight of `share` times all words, at most
    most_passes times the source's size. What a full source leaves is shared again by weight, until none is
    above: sources fill up in the order of size by weight, so the full ones are a prefix of that order. base: the words of
    the sources of earlier places."""
    name = F.col("source").asc_nulls_last()
    one = per_source.withColumn("one", F.lit(1).cast("long"))
    df = running(one, [name], {"place": "one", "base": "source_size"}).drop("one").withColumn("weight", _cycle(weights, F.col("place")))
    df = df.withColumn("cap", F.col("source_size") * F.lit(float(most_passes))).withColumn("full", F.col("cap") / F.col("weight"))
    df = common.stash(running(df, ["full", "place"], {"cap_before": "cap", "weight_before": "weight"}), "mix-filling")
    words, weight = df.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    budget = words * float(share)
    df = df.withColumn("is_full", F.col("full") * (F.lit(weight) - F.col("weight_before")) <= F.lit(budget) - F.col("cap_before"))
    taken, free = df.agg(F.coalesce(F.sum(F.when(F.col("is_full"), F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~F.col("is_full"), F.col("weight"))), F.lit(1.0))).first()
    target = F.when(F.col("is_full"), F.col("cap")).otherwise(F.col("weight") * F.lit(budget - taken) / F.lit(free))
    return df.select("source", "place", "weight", "source_size", "base", target.alias("target"))


def due(word: Column, target: Column, place: Column, ramps=RAMPS) -> Column:
    """The time at which the cumulative demand target * (s t + (e - s) t^2 / 2) reaches word; null if it never does."""
    start, bend = _cycle([s for s, _ in ramps], place), _cycle([(e - s) / 2 for s, e in ramps], place)
    y = F.when(target > 0, word / target).otherwise(0.0)
    t = F.when(bend == 0, y / start).otherwise((F.sqrt(F.greatest(F.lit(0.0), start * start + 4 * bend * y)) - start) / (2 * bend))
    return F.when(word <= target, F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))


def sized(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """row (a number of its own for each row, once it is stored), doc_id, source, size, draw (a digest of id, source and text) and
    `carry`."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    draw = F.md5(F.concat_ws("|", text("doc_id"), text("source"), F.md5(text("text").cast("binary"))).cast("binary"))
    columns = documents.select("doc_id", "source", word_count().alias("size"), draw.alias("draw"), *carry)
    return columns.withColumn("row", F.monotonically_increasing_id())


def sized_rows(documents: DataFrame) -> DataFrame:
    """sized() in shared storage."""
    return common.stash(sized(documents), "mix-sizes")


def _with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows with their source's row, by source and salt, as a source may have any share of all rows."""
    salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "their")
    salted = salted.repartition("their", "salt")  # so that Spark knows its size, SALTS times that of targets, before it broadcasts it
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, rows["source"].eqNullSafe(salted["their"]) & (rows["salt"] == salted["salt"])).drop("their", "salt")


def assigned(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most_passes: float = MOST_PASSES, ramps=RAMPS) -> DataFrame:
    """Stored sized() -> a row for each, with source_size, target and positions (array<double>, those of its copies)."""
    narrow = rows.select("row", "doc_id", "source", "size", "draw")
    per_source = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = common.stash(source_targets(per_source, weights, share, most_passes), "mix-targets")
    # Rows equal up to their number are the same document twice, and may change places.
    placed = running(_with_targets(narrow, targets), ["place", "draw", "row"], {"words": "size"})
    before = F.col("words") - F.col("base")
    passes = F.sequence(F.lit(0), F.when(F.col("source_size") > 0, F.lit(int(most_passes) - 1)).otherwise(F.lit(0)))
    middle = lambda j: before + j * F.col("source_size") + F.col("size") / 2
    positions = F.array_compact(F.transform(passes, lambda j: due(middle(j), F.col("target"), F.col("place"), ramps)))
    return placed.select("row", "doc_id", "source", "size", "draw", "source_size", "target", positions.alias("positions"))


def training_order(copies: DataFrame) -> DataFrame:
    """assigned() -> row, rank, position of each copy taken, in the training order; ranks are places in it from 0."""
    each = copies.select("row", "draw", F.posexplode("positions").alias("copy", "position"))
    return number(each, ["position", "draw", "copy", "row"], "rank").select("row", "rank", "position")


def plan(documents: DataFrame, **schedule) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, and of its copies in the training order: taken (their
    words), n_copies, positions (array<double>) and ranks (array<bigint>)."""
    copies = common.stash(assigned(sized_rows(documents), **schedule), "mix-positions")
    found = training_order(copies).groupBy("row").agg(F.array_sort(F.collect_list("rank")).alias("ranks"), F.count("*").alias("n_copies"))
    none = F.array().cast("array<bigint>")
    out = copies.join(common.moved(found), "row", "left").withColumns({"n_copies": F.coalesce("n_copies", F.lit(0)).cast("long"), "ranks": F.coalesce("ranks", none)})
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"), "n_copies", "positions", "ranks")


def mix(documents: DataFrame, **schedule) -> DataFrame:
    """The training stream: the columns of documents, a row for each copy taken, range-sorted by position. Documents are stored once,
    bucketed by row, so the join with their positions does not move them; only the copies move, to their places."""
    columns = {c: f"c{i}" for i, c in enumerate(documents.columns)}
    buckets = max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = documents.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`").alias(name) for c, name in columns.items()]).alias("held_"))
    # Every task has a file in each bucket, so there are half as many tasks as buckets at most.
    held = common.bucketed(sized(named, carry=("held_",)).coalesce(max(1, buckets // 2)), ["row"], buckets, "mix-documents")
    copies = assigned(common.stash(held.drop("held_"), "mix-sizes"), **schedule).select("row", "draw", F.posexplode("positions").alias("copy_", "position_"))
    stream = held.select("row", "held_").join(common.moved(copies), "row")
    ordered = stream.repartitionByRange("position_", "draw", "copy_", "row").sortWithinPartitions("position_", "draw", "copy_", "row")
    return ordered.select(*[F.col(f"held_.{name}").alias(c) for c, name in columns.items()])
