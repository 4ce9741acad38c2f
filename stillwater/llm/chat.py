"""Preference formatting of chat conversations, in DataFrame operations only.

A preference pair is two conversations, the chosen and the rejected one. Their longest common prefix of turns is
rendered once, as the prompt; what follows in each is rendered as that side's completion. A completion's mask
lists the spans (code points, end exclusive) of its text that a model learns from: the assistant turns'
contents with their end mark. Everything else, the prompt included, is masked out.

Turns are rendered as "<|role|>\\n" + content + "<|end|>\\n". In contents "<|" is written "<||", which undoes
itself, so that no content can pose as a mark; other characters than letters, digits, "_" and "-" in a role are
written "_".

Defined cases: a null role is "unknown", a null text is empty; equal turns at different places are still
different turns; turns are ordered by turn, then role, then text, a null turn first, and repeated rows repeat a
turn; equal conversations share all turns and have two empty completions; one that is the other's beginning has
one; rows without a conversation id are no conversation; empty tables give empty tables; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
#: Conversations of one opening that a salt takes.
SALT_ROWS = 4_096
TRAINED = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, turns: array<struct<role, text>> in order. A group is one conversation."""
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return grouped.select("conv_id", F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """The number of turns that both lists begin with."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("long")


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.regexp_replace(role, "[^A-Za-z0-9_-]", "_"), F.lit(CLOSE))


def _body(text: Column) -> Column:
    return F.concat(F.replace(text, F.lit("<|"), F.lit("<||")), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(_head(x["role"]), _body(x["text"]))), "")


def learnt_spans(turns: Column) -> Column:
    """array<struct<start, end>> of the trained turns' contents and end marks in render(turns)."""
    sizes = F.transform(turns, lambda x: F.struct((x["role"] == TRAINED).alias("learnt"), F.length(_head(x["role"])).cast("long").alias("h"), F.length(_body(x["text"])).cast("long").alias("b")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        first, last = acc["at"] + x["h"], acc["at"] + x["h"] + x["b"]
        more = F.when(x["learnt"], F.array(F.struct(first.alias("start"), last.alias("end")))).otherwise(F.array().cast("array<struct<start: bigint, end: bigint>>"))
        return F.struct(last.alias("at"), F.concat(acc["spans"], more).alias("spans"))

    return F.aggregate(sizes, start, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pairs with chosen and rejected (array<struct<role, text>>) -> their other columns, and n_common, prompt,
    chosen_text, chosen_spans, rejected_text, rejected_spans."""
    rest = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    cut = pairs.withColumn("n_common", common_turns(F.col("chosen"), F.col("rejected")))

    def after(c: str) -> Column:
        n = F.col("n_common").cast("int")
        return F.slice(F.col(c), n + 1, F.greatest(F.size(c) - n, F.lit(0)))

    cut = cut.withColumns({"shared_": F.slice("chosen", F.lit(1), F.col("n_common").cast("int")), "chosen_": after("chosen"), "rejected_": after("rejected")})
    return cut.select(
        *[F.col(f"`{c}`") for c in rest], "n_common", render(F.col("shared_")).alias("prompt"),
        render(F.col("chosen_")).alias("chosen_text"), learnt_spans(F.col("chosen_")).alias("chosen_spans"),
        render(F.col("rejected_")).alias("rejected_text"), learnt_spans(F.col("rejected_")).alias("rejected_spans"),
    )


def pairs_by_opening(chats: DataFrame) -> DataFrame:
    """kind, chosen_id, rejected_id, chosen, rejected: of the conversations that open with the same turn, that of the
    least id is chosen over each other one. An opening may be shared by any number of conversations: the least id is a
    partial aggregate; of an opening that more than SALT_ROWS share, the chosen conversation is dealt with each of its salts,
    and the others by theirs. These openings are few, rows / SALT_ROWS at most, and join by a row of a digest and a number."""
    first = F.col("turns")[0]
    opened = chats.withColumn("opening", F.concat(F.sha2(first["role"], 256), F.sha2(first["text"], 256)))  # digests of one length cannot run together
    least = opened.groupBy("opening").agg(F.min("conv_id").alias("chosen_id"), F.count("*").alias("n")).where("n > 1")
    salts = least.select("opening", "chosen_id", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts"))
    best = opened.select("opening", F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen")).join(salts, ["opening", "chosen_id"])
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    hot = opened.join(salts.where("salts > 1").select("opening", "salts"), "opening", "left")
    dealt = hot.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    others = dealt.join(best, ["opening", "salt"]).where("conv_id <> chosen_id")
    return others.select(F.lit("opening").alias("kind"), "chosen_id", F.col("conv_id").alias("rejected_id"), "chosen", F.col("turns").alias("rejected"))


def pairs_by_answer(chats: DataFrame) -> DataFrame:
    """kind, chosen_id, rejected_id, chosen, rejected: a conversation up to its last assistant turn is chosen over the
    same with its first assistant turn's content there, an answer to another question. Both ids are its own."""
    roles = F.transform("turns", lambda x: x["role"])
    last = F.size("turns") - F.array_position(F.reverse(roles), F.lit(TRAINED)) + 1
    two = chats.where(F.size(F.filter("turns", lambda x: x["role"] == TRAINED)) > 1).withColumn("last_", last.cast("int"))
    first = F.filter("turns", lambda x: x["role"] == TRAINED)[0]
    return two.select(
        F.lit("answer").alias("kind"), F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"),
        F.slice("turns", F.lit(1), F.col("last_")).alias("chosen"), F.concat(F.slice("turns", F.lit(1), F.col("last_") - 1), F.array(first)).alias("rejected"),
    )
