"""Reading only what a batch can touch of a large target (D1-D4): key ranges and a bit array made from the batch.

The target may be far larger than the batch.  Two summaries of the batch's keys, both of bounded size, cut
it down before anything of it is shuffled:

- at most ``RANGES`` intervals that hold all keys, from a range partitioning of the batch; as plain comparisons
  they reach the Parquet scan, which leaves out row groups and pages by their statistics;
- a bit array of ``WORDS`` 64-bit words (a blocked Bloom filter), merged from partial aggregates; a row whose
  three bits are not all set in its word has a key that the batch doesn't name.

Neither ever loses a row that the batch names: what comes through is a superset, and an exact join follows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGES = 64
WORDS = 1 << 18          # 2 MB of bits: the broadcast never has more rows than this

#: Types whose smallest and largest value come back unchanged from text.
RANGED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.DateType, T.TimestampNTZType, T.StringType)


def key_ranges(keys: DataFrame, key: str, most: int = RANGES) -> list[tuple[str, str]] | None:
    """At most ``most`` closed intervals, as texts, that hold every key that isn't NULL; None for a type without them."""
    kind = keys.schema[key].dataType
    if not isinstance(kind, RANGED) or (isinstance(kind, T.StringType) and kind != T.StringType()):
        return None
    k = F.col(f"`{key}`")
    parts = keys.where(k.isNotNull()).select(k.alias("k")).repartitionByRange(most, "k").groupBy(F.spark_partition_id()).agg(
        F.min("k").cast("string").alias("lo"), F.max("k").cast("string").alias("hi"))
    return [(r["lo"], r["hi"]) for r in parts.collect()]      # one row per range partition


def in_ranges(key: Column, kind: T.DataType, ranges: list[tuple[str, str]]) -> Column:
    def bound(text: str) -> Column:
        return F.lit(text).cast(kind)

    return reduce(lambda a, b: a | b, [key.between(bound(lo), bound(hi)) for lo, hi in sorted(ranges)], F.lit(False))


def _word(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(WORDS))


def _mask(key: Column) -> Column:
    """Three bits of a word."""
    h = F.xxhash64(key, F.lit(1))
    one = F.lit(1).cast("bigint")
    bits = [F.call_function("shiftleft", one, F.shiftright(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(3)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def key_bits(keys: DataFrame, key: str) -> DataFrame:
    """(_word, _bits): the words of the bit array that have a bit, at most ``WORDS`` rows."""
    k = F.col(f"`{key}`")
    return keys.where(k.isNotNull()).groupBy(_word(k).alias("_word")).agg(F.bit_or(_mask(k)).alias("_bits"))


def maybe_touched(target: DataFrame, keys: DataFrame, key: str, most: int = RANGES) -> DataFrame:
    """The rows of ``target`` whose ``key`` may be among ``keys``: all that are, and few others."""
    kind = target.schema[key].dataType
    named = keys.select(F.col(f"`{key}`").cast(kind).alias(key))
    ranges = key_ranges(named, key, most)
    k = F.col(f"`{key}`")
    some = target if ranges is None else target.where(in_ranges(k, kind, ranges))
    # a semi join, so that the exact join which follows is not moved below it
    has_bits = (_word(k) == F.col("_word")) & (F.col("_bits").bitwiseAND(_mask(k)) == _mask(k))
    return some.where(k.isNotNull()).join(F.broadcast(key_bits(named, key)), has_bits, "left_semi")


def touched(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Exactly the rows of ``target`` whose ``key`` is among ``keys`` (a NULL key never is)."""
    named = keys.select(F.col(f"`{key}`").cast(target.schema[key].dataType).alias(key))
    return maybe_touched(target, keys, key).join(named, key, "left_semi").select(*[F.col(f"`{c}`") for c in target.columns])
