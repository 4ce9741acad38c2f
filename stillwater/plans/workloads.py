"""Chains and distributions taken from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stillwater.sources.models import BooleanModel, parse_model

#: Small published example models, whose long-run distributions are known.
TOY = parse_model("A, A\nC, !A & !D\nD, !A & !C")
RING = parse_model("A, C\nB, !A\nC, B")
PAIR = parse_model("A, B\nB, !A")
LATCH = parse_model("A, !B\nB, !A & C\nC, B | C")
#: Five nodes over the bits of a lineitem row: returned, shipped, discounted, taxed, large.
ROWS = parse_model("R, R & !F | D & Q\nF, F | R & T\nD, D & !(T & Q) | !R\nT, !(R & F) & T\nQ, Q & D | F & !T")
ROW_BITS = ("l_returnflag = 'R'", "l_linestatus = 'F'", "l_discount >= 0.05", "l_tax >= 0.04", "l_quantity > 25")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def row_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state for each lineitem row."""
    state = sum((F.expr(f"CASE WHEN {c} THEN {1 << i}L ELSE 0L END") for i, c in enumerate(ROW_BITS)), F.lit(0).cast("long"))
    return table(spark, sf_dir, "lineitem").select(state.alias("state"))


def event_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, rate: how often a user's event of one type is followed by one of another; types by number."""
    code = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")).cast("long") - 1
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", code.alias("src"))
    follows = e.withColumn("dst", F.lead("src").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("dst is not null")
    return follows.groupBy("src", "dst").agg(F.count("*").cast("double").alias("rate"))


def mask_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, rate: how often a user's set of event types seen so far grows from one to another; sets as bit masks."""
    code = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")).cast("int") - 1
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("b", F.pow(F.lit(2), code).cast("long"))
    e = e.withColumn("m", F.bit_or("b").over(by_user.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("before", F.lag("m").over(by_user)).where("before is not null and before <> m")
    return e.groupBy(F.col("before").alias("src"), F.col("m").alias("dst")).agg(F.count("*").cast("double").alias("rate"))


def nation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, rate: each customer nation's two most frequent supplier nations, loops left out; rate is the number of
    line items. Nations are joined after the line items have been counted by order and supplier nation."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    per_order = items.groupBy("l_orderkey", "dst").agg(F.count("*").alias("n"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    counts = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst")))
    return best.where("r <= 2 and src <> dst").select("src", "dst", F.col("n").cast("double").alias("rate"))


def nation_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """state, p: the share of the customers in each nation."""
    from stillwater.operators.states import empirical

    return empirical(table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("state")))


def model_edges(spark: SparkSession, model: BooleanModel) -> DataFrame:
    from stillwater.operators import states, transitions

    return transitions.successors(states.space(spark, len(model.nodes)), model)


def order_part_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, rate: orders (2 * key) and parts (2 * key + 1) that line items link, and every part with state 0. A link's rate
    is its number of line items times 1 + src % 7, so a state's long-run share is as 1 / (1 + state % 7)."""
    items = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 2).cast("long").alias("src"), (F.col("l_partkey") * 2 + 1).cast("long").alias("dst"))
    counted = items.groupBy("src", "dst").agg(F.count("*").alias("n"))
    hub = items.select(F.lit(0).cast("long").alias("src"), "dst").distinct().withColumn("n", F.lit(1).cast("long"))
    one = counted.unionByName(hub)
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    return both.select("src", "dst", (F.col("n") * (1 + F.col("src") % 7)).cast("double").alias("rate"))


def next_orders(spark: SparkSession, sf_dir: str, year: int = 1995) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, rate) from each order of a year to its customer's next one, and those of urgent priority alike, as
    (state, p): as many weak components as customers, many without any urgent order."""
    orders = table(spark, sf_dir, "orders").where(F.year("o_orderdate") == year)
    in_turn = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    edges = orders.select(F.col("o_orderkey").cast("long").alias("src"), F.lead("o_orderkey").over(in_turn).cast("long").alias("dst"), F.lit(1.0).alias("rate")).where("dst is not null")
    urgent = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("long").alias("state"))
    total = urgent.agg(F.count("*").alias("total"))  # one row
    return edges, urgent.join(F.broadcast(total)).select("state", (1 / F.col("total")).alias("p"))
