"""States as BIGINT bit masks: bit i is node i in the model's order, lowest bit first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_NODES = 62


def mask(i: int) -> Column:
    return F.lit(1 << i).cast("long")


def bit(state: Column, i: int) -> Column:
    """Whether bit i is set."""
    return state.bitwiseAND(mask(i)) != F.lit(0)


def flip(state: Column, i: int) -> Column:
    return state.bitwiseXOR(mask(i))


def deposit(counter: Column, free: list[int], fixed: int = 0) -> Column:
    """The counter's bits put to the places `free`, and the fixed bits: enumerates the states of a sub-cube."""
    out = F.lit(fixed).cast("long")
    for k, place in enumerate(free):
        out = out + F.shiftleft(F.shiftright(counter, k).bitwiseAND(F.lit(1).cast("long")), place)
    return out


def matches(state: Column, positive: Column, negative: Column) -> Column:
    """Whether a clause of two masks holds: all positive bits set, no negative bit set."""
    return (state.bitwiseAND(positive) == positive) & (state.bitwiseAND(negative) == F.lit(0))


def changed(src: Column, dst: Column) -> Column:
    """Which bit an edge flips."""
    return F.bit_count(src.bitwiseXOR(dst) - F.lit(1)).cast("int")


def goes_up(src: Column, dst: Column) -> Column:
    return dst > src


def decode(state: Column, nodes: list[str], separator: str = " --- ", empty: str = "<nil>") -> Column:
    """The names of the set bits."""
    on = F.array_compact(F.array(*[F.when(bit(state, i), F.lit(n)) for i, n in enumerate(nodes)]))
    return F.when(state == F.lit(0), F.lit(empty)).otherwise(F.array_join(on, separator))


def clause_text(positive: Column, negative: Column, nodes: list[str]) -> Column:
    """A clause of two masks as text: "A & !B"; the clause that always holds is "1"."""
    parts = F.array_compact(F.array(*[F.when(bit(positive, i), F.lit(n)).when(bit(negative, i), F.lit(f"!{n}")) for i, n in enumerate(nodes)]))
    return F.when(F.size(parts) == 0, F.lit("1")).otherwise(F.array_join(parts, " & "))
