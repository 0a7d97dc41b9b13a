"""Join helpers: counted bounds, and a Bloom filter that prunes keys before a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_rows(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.  Reads at most
    max_rows + 1 rows (a LIMIT, not a full count)."""
    return df.limit(max_rows + 1).count() <= max_rows


BLOOM_BITS = 1 << 22  # 512 KB, the least: lets about 1 in 10,000 other keys through at 16,000 keys
BLOOM_MOST_BITS = 1 << 25  # 4 MB: a filter that travels with the tasks; with 16 MB the driver's heap of 750 MB was too small
BLOOM_MOST_SHARED = 1 << 27  # 16 MB: a filter that is broadcast once; 1 in 140 at 6 million keys
BITS_A_KEY = 32  # 1 in 250 at most, up to the largest filter
BLOCK = 1 << 10  # words of the filter that are put in order together
SALTS = 16


def filter_bits(n_keys: int, most: int = BLOOM_MOST_BITS) -> int:
    """Bits of a ``key_filter`` of ``n_keys`` keys: a power of two that grows with their number, up to ``most``."""
    return min(max(1 << (BITS_A_KEY * n_keys - 1).bit_length(), BLOOM_BITS), most) if n_keys > 0 else BLOOM_BITS


def sorted_join(left: DataFrame, right: DataFrame, on: str | list[str] | Column) -> DataFrame:
    """Inner join by shuffle and sort, whatever the planner estimates.  It takes a small compressed
    file for a small table: a million names or runs of them, 10 MB of parquet, were collected by the driver."""
    return left.join(right.hint("merge"), on)


def _bits_of(key: Column, bits: int) -> list[Column]:
    """Two independent bits of ``key``."""
    return [F.pmod(F.xxhash64(key), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(bits))]


def key_filter(dictionary: DataFrame, bits: int = BLOOM_BITS) -> DataFrame:
    """One row, one array of ``bits`` / 64 longs: the bits of the hashes of ``key``."""
    marks = dictionary.select(F.explode(F.array(*_bits_of(F.col("key"), bits))).alias("at")).select(F.expr("at div 64").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("mark"))
    empty = dictionary.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mark"))
    words = marks.unionByName(empty).groupBy("word").agg(F.bit_or("mark").alias("mark"))
    blocks = words.groupBy(F.expr(f"word div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("word", "mark"))).alias("w"))
    blocks = blocks.select("block", F.transform("w", lambda x: x["mark"]).alias("words"))
    return blocks.agg(F.array_sort(F.collect_list(F.struct("block", "words"))).alias("b")).select(F.flatten(F.transform("b", lambda x: x["words"])).alias("words"))


def may_hold(key: Column, words: Column, bits: int = BLOOM_BITS) -> Column:
    """Whether ``key`` can be among the keys of ``key_filter``; false for none of them."""
    def marked(at):
        word = F.element_at(words, (F.floor(at / 64) + 1).cast("int"))
        return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))) != 0

    one, other = _bits_of(key, bits)
    return marked(one) & marked(other)


def pruned(rows: DataFrame, dictionary: DataFrame, bits: int) -> DataFrame:
    """The rows whose ``key`` can be among the dictionary's.  The filter is one row, broadcast
    once: as a scalar subquery every task's closure would hold copies of it."""
    words = F.broadcast(key_filter(dictionary, bits))
    return rows.crossJoin(words).where(F.col("key").isNotNull() & may_hold(F.col("key"), F.col("words"), bits)).drop("words")


def salted_join(rows: DataFrame, dictionary: DataFrame, spread: Column, salts: int = SALTS) -> DataFrame:
    """Inner join on ``key`` with a ``dictionary`` of distinct keys: the rows of one key go to
    ``salts`` tasks by ``spread`` (a long), each with the dictionary's row."""
    each = dictionary.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return sorted_join(rows.withColumn("_salt", F.pmod(spread, F.lit(salts).cast("long"))), each, ["key", "_salt"]).drop("_salt")
