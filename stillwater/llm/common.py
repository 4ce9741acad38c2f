"""Helpers shared by the operators of this subpackage: shared storage, column batches, words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwater.operators.storage import folder, keep

#: A word: a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = (9, 10, 11, 12, 13, 32)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stash(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends in files that outlive any executor."""
    return keep(df, codec, f"stillwater/{label}")


def bucketed(df: DataFrame, by: list[str], buckets: int, label: str) -> DataFrame:
    """df in shared storage, dealt by columns, so that joins by them need not move it again."""
    path = folder(df.sparkSession, f"stillwater/{label}")
    name = f"{label}_{path.rsplit('/', 1)[1]}".replace("-", "_")
    df.write.bucketBy(buckets, *by).option("compression", "zstd").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def among(df: DataFrame, column: str, ids: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """The rows of df whose column is in ids (one column of that name and type), and a few others, whose hashes meet: told by a
    broadcast table of so many bits, whatever the number of ids, so that a join with ids need not move all rows of df. A null is in ids
    if they have one. df has no columns word_ and bits_."""
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    table = ids.select(word.alias("word_"), bit.alias("bit_")).groupBy("word_").agg(F.bit_or("bit_").alias("bits_"))
    return df.join(F.broadcast(table), word == F.col("word_")).where(bit.bitwiseAND(F.col("bits_")) != 0).select(*df.columns)


def moved(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the input: both sides are dealt by the key and merged, and neither is broadcast. Spark sizes a
    side by its compressed files, an array in it as one element and an explode as no more rows, so it would send tables through the driver
    that are many times its bound of 10 MB."""
    return df.hint("merge")


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow. Spark cuts batches at spark.sql.execution.arrow.maxBytesPerBatch (64 MB) at the latest."""
    return df.mapInArrow(f, schema)


def strongest(df: DataFrame, value: str, most: int, step: float = 0.125) -> DataFrame:
    """The `most` rows of the highest positive `value`, or all if there are fewer. Histograms give the bound: over logarithms,
    in the bin that passes `most` over finer ones, and in that one's bin over digits of a hash of the row, until few rows
    are left to sort. Ties and values that differ by less than a 10,000th are so cut by the hash. No task or driver holds
    more than one histogram of some thousand bins, or those few rows."""
    df = df.where(F.col(value) > 0)
    exponent, digits = F.log2(F.col(value)), F.xxhash64(*df.columns)
    levels = [F.floor(exponent / step), F.floor(exponent / step * 1024), *(F.shiftrightunsigned(digits, n).bitwiseAND(F.lit(4095)) for n in (52, 40, 28, 16, 4))]
    whole, left = df.limit(0), most
    for level in levels:
        bins = df.withColumn("bin_", level)
        taken, least, cut = 0, None, None
        for b, n in sorted(bins.groupBy("bin_").count().collect(), reverse=True):
            if taken + n > left:
                cut = (b, n)
                break
            taken, least = taken + n, b
        if least is not None:
            whole, left = whole.union(bins.where(F.col("bin_") >= least).drop("bin_")), left - taken
        if cut is None or not left:
            return whole
        df = bins.where(F.col("bin_") == cut[0]).drop("bin_")
        if cut[1] <= 4096:
            break
    return whole.union(df.orderBy(F.desc(value), *df.columns).limit(left))


def crc_bucket(column: str = "doc_id", of: int = 5):
    """crc32 of an id's decimal text, modulo `of`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % of


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have yet, so that added columns never clash."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


# --------------------------------------------------------------------------- text in columns


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one after another, and its n + 1 offsets; a null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has at most `most` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_RADIX = np.uint64(0x9E3779B97F4A7C15)
#: What a byte adds to a word's hash: nothing if it lies between words.
_VALUE = np.where(_SEPARATOR, np.uint64(0), _BYTE[_LOWER])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, at: np.ndarray, separator: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes, and for each text the number of its first word (n + 1 numbers).
    separator: for each byte, whether it lies between words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    gap = (_SEPARATOR if separator is None else separator)[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    before[at[:-1][at[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, gap[1:]
    after[at[1:][at[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, separator: np.ndarray | None = None, most: int | None = None) -> np.ndarray:
    """A 64-bit hash of each word, A-Z taken as a-z: a polynomial over byte values drawn at random, then mixed.
    most: take so many first bytes of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if separator is None:
        value = _VALUE[data]
    else:
        value = np.where(separator[data], np.uint64(0), _BYTE[_LOWER[data]])
    # Places in words; separators, before the first word too, have the value 0 whatever their place.
    place = np.arange(len(data))
    place -= np.repeat(starts, np.diff(np.append(np.append(0, starts[1:]), len(data))))
    place[: starts[0]] = 0
    if most is not None:
        value[place >= most] = 0
    # A separator run adds nothing, whatever its place; only places inside words need powers.
    longest = int(place.max()) + 1
    powers = np.empty(longest, np.uint64)
    powers[0] = 1
    if longest > 1:
        powers[1:] = _RADIX
        powers = np.multiply.accumulate(powers)
    return mix(np.add.reduceat(value * powers[place], starts))
