"""Candidates that nothing excludes: a filter of bits lets most of them pass before any join, exact anti joins settle the rest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter for each key, and at most: as words of 64 bits these are the rows that are broadcast, whatever the number of keys.
BITS, MOST = 16, 1 << 25


def _mask(h: Column) -> Column:
    """Three of a word's 64 bits."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, n).bitwiseAND(F.lit(63)).cast("int")) for n in (0, 6, 12)])


def word_filter(keys: DataFrame, on: list[str], bits: int) -> DataFrame:
    """(slot, word): a blocked Bloom filter of ``keys``, built by one aggregate that map tasks combine; at most bits / 64 rows."""
    h = F.xxhash64(*on)
    return keys.groupBy(F.pmod(F.shiftrightunsigned(h, 18), F.lit(bits // 64)).alias("slot_")).agg(F.bit_or(_mask(h)).alias("word_"))


def split(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` that no key equals for sure, and those that one may."""
    bits = 64
    wanted = min(MOST, keys.count() * BITS)
    while bits < wanted:
        bits *= 2
    h = F.xxhash64(*on)
    held = rows.withColumn("slot_", F.pmod(F.shiftrightunsigned(h, 18), F.lit(bits // 64))).join(F.broadcast(word_filter(keys, on, bits)), "slot_", "left")  # at most MOST / 64 rows
    maybe = F.coalesce(F.col("word_").bitwiseAND(_mask(h)) == _mask(h), F.lit(False))
    return held.filter(~maybe).select(rows.columns), held.filter(maybe).select(rows.columns)


def without(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` whose columns ``on`` equal no row of ``keys``; only rows that the filter can't clear are shuffled."""
    clear, doubtful = split(rows, keys, on)
    return clear.unionByName(doubtful.join(keys.select(*on), on, "left_anti"))


def unexcluded(candidates: DataFrame, focus: DataFrame, known: DataFrame, accepted: DataFrame, discarded: DataFrame, searched: DataFrame, shared: list[str]) -> DataFrame:
    """Candidates (seed_id, root) but for the seed's focus root, its known, accepted and discarded roots (seed_id, root each), roots that were searched from before
    (root), and roots that many share. Candidates without a root don't count."""
    of_seed = reduce(DataFrame.union, [x.select("seed_id", "root") for x in (focus, known, accepted, discarded)]).distinct()
    rows = candidates.filter((F.coalesce("root", F.lit("")) != "") & ~F.col("root").isin(shared))
    return without(without(rows, of_seed, ["seed_id", "root"]), searched.select("root").distinct(), ["root"])
