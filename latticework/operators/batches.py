"""Greedy batches under a budget, of groups of any size: a group is split over tasks.

Where a batch ends depends on where it began, so one walk through a group settles it; here the walk is done from all places
at once. Rows are dealt into ranges of (group, order) of about ``ROWS`` rows. Inside a range each row's jump, to the first row that doesn't fit with
it, is a binary search in prefix sums. What a range does to a walk that enters it depends only on what the open batch may still
take. All that can leave a range is known from its jumps alone, and these few values are what can enter the next, so each range
maps its possible entries to its exits, all ranges at once. The true entries follow from the group's begin by pointer doubling over these
maps, in as many rounds as the number of ranges of the largest group has binary digits. With its entry each range numbers its own rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.session import stored

#: Rows of a range, about.
ROWS = 1 << 16


def jumps(sizes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums (a row that is too large counts as just too large), for each row the first that doesn't fit with it, and whether a batch that
    begins there and ends in this range takes anything."""
    ends = np.cumsum(np.minimum(sizes, budget + 1))
    begins = ends - np.minimum(sizes, budget + 1)
    after = np.maximum(np.searchsorted(ends, begins + budget, "right"), np.arange(len(sizes)) + 1)
    inside = after < len(sizes)
    used = begins[np.minimum(after, len(sizes) - 1)] - begins
    return ends, after, inside & (sizes <= budget) & (used > 0)


def tails(sizes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For a walk that begins a batch at each row: what the batch that is open at the end may still take (-1: none is open), and how many were closed."""
    ends, after, closed = jumps(sizes, budget)
    begins = ends - np.minimum(sizes, budget + 1)
    left, count = (budget - (ends[-1] - begins)).tolist(), closed.astype(np.int64).tolist()
    for i in range(len(sizes) - 1, -1, -1):
        if after[i] < len(sizes):
            left[i] = left[after[i]]
            count[i] += count[after[i]]
    return np.array(left, np.int64), np.array(count, np.int64)


def _taken(ends: np.ndarray, budget: int, entry: int, at: int) -> int:
    """1 if the batch that is open at the entry, and ends before row ``at``, takes anything."""
    return int(entry >= 0 and (entry < budget or (at > 0 and ends[at - 1] > 0)))


def crossing(sizes: np.ndarray, budget: int, entries: list[int]) -> list[tuple[int, int]]:
    """For each entry (what the open batch may still take) the exit and the number of batches closed."""
    left, count = tails(sizes, budget)
    ends = np.cumsum(np.minimum(sizes, budget + 1))
    out = []
    for e in entries:
        at = int(np.searchsorted(ends, e, "right"))
        out.append((e - int(ends[-1]), 0) if at == len(sizes) else (int(left[at]), _taken(ends, budget, e, at) + int(count[at])))
    return out


def numbers(sizes: np.ndarray, budget: int, entry: int, before: int) -> np.ndarray:
    """Each row's batch, -1 for rows that are too large."""
    ends, after, closed = jumps(sizes, budget)
    out = np.full(len(sizes), before, np.int64)
    at = int(np.searchsorted(ends, entry, "right"))
    if at < len(sizes):
        before += _taken(ends, budget, entry, at)
    while at < len(sizes):
        out[at : after[at]] = before
        before += int(closed[at])
        at = int(after[at])
    out[sizes > budget] = -1
    return out


def _sections(t: pa.Table) -> list[tuple[str, int, int]]:
    """Groups of a sorted range: key, first row, row after the last."""
    keys = t.column("_key").to_pylist()
    cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
    return [(keys[a], a, z) for a, z in zip(cuts, cuts[1:], strict=False)]


def _sizes(t: pa.Table) -> np.ndarray:
    return t.column("_size").to_numpy().astype(np.int64)


def budget_batches(rows: DataFrame, by: list[str], order: str, size: str, budget: int, range_rows: int = ROWS) -> DataFrame:
    """``rows`` with their batch: rows of a group in order, each batch within ``budget``; a row larger than that is in none (null) and ends the batch before it.

    Null groups are a group, null sizes count as 0, negative ones are an error; rows of equal order stand in any order. Batches are numbered from 0 in each group; one that has
    taken nothing but rows of size 0 when a row that is too large ends it is not counted.
    """
    whole = F.coalesce(F.col(size).cast("bigint"), F.lit(0))
    sized = F.when(whole < 0, F.raise_error(F.lit("a size is negative"))).otherwise(whole)
    ranges = max(1, -(-rows.count() // range_rows))
    dealt = rows.repartitionByRange(ranges, *by, order).sortWithinPartitions(*by, order)
    at = F.monotonically_increasing_id()
    dealt = stored(dealt.select(*rows.columns, F.to_json(F.struct(*by)).alias("_key"), sized.alias("_size"), at.alias("_at")).withColumn("_part", F.shiftright("_at", 33)), "ranges")
    slim = dealt.select("_part", "_at", "_key", "_size")

    def ends(t: pa.Table) -> pa.Table:
        t = t.sort_by("_at")
        sections, s = _sections(t), _sizes(t)
        out = []
        for key, a, z in {x[0]: x for x in (sections[0], sections[-1])}.values():
            left = np.unique(tails(s[a:z], budget)[0])
            out.append({"part": t.column("_part")[0].as_py(), "key": key, "total": int(np.minimum(s[a:z], budget + 1).sum()), "exits": left.tolist()})
        return pa.Table.from_pylist(out, pa.schema([("part", pa.int64()), ("key", pa.string()), ("total", pa.int64()), ("exits", pa.list_(pa.int64()))]))

    chunks = stored(slim.groupBy("_part").applyInArrow(ends, "part bigint, key string, total bigint, exits array<bigint>"), "chunks")
    w = Window.partitionBy("key").orderBy("part")
    several = chunks.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = stored(chunks.join(several, "key", "left_semi").withColumn("idx", F.row_number().over(w) - 1), "chunks")
    longest = chunks.agg(F.max("idx")).first()[0]
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("batch", T.IntegerType())])
    entry = _entries(chunks, slim, budget, longest) if longest else rows.sparkSession.createDataFrame([], "part bigint, key string, entry bigint, before bigint")

    def number(t: pa.Table, entries: pa.Table) -> pa.Table:
        t = t.sort_by("_at")
        known = {r["key"]: (r["entry"], r["before"]) for r in entries.to_pylist()}
        s = _sizes(t)
        batch = np.concatenate([numbers(s[a:z], budget, *known.get(key, (-1, 0))) for key, a, z in _sections(t)] or [np.zeros(0, np.int64)])
        return t.select(names).append_column("batch", pa.array(batch, pa.int32(), mask=batch < 0))

    return dealt.groupBy("_part").cogroup(entry.withColumnRenamed("part", "_part").groupBy("_part")).applyInArrow(number, schema)


def _entries(chunks: DataFrame, slim: DataFrame, budget: int, longest: int) -> DataFrame:
    """What enters each range of the groups that have several: (part, key, entry, before)."""
    # possible entries: the begin of a group, the exits of the range before, and entries that a whole range fits into
    new = chunks.filter("idx = 0").select("key", "idx", F.lit(-1).cast("bigint").alias("entry"))
    new = new.union(chunks.select("key", (F.col("idx") + 1).alias("idx"), F.explode("exits").alias("entry")).filter(F.col("idx") <= longest))
    new = known = stored(new.distinct(), "possible")
    while True:
        through = new.join(chunks.filter(F.col("total") <= budget), ["key", "idx"]).filter("entry >= total").select("key", (F.col("idx") + 1).alias("idx"), (F.col("entry") - F.col("total")).alias("entry"))
        new = stored(through.distinct().join(known, ["key", "idx", "entry"], "left_anti"), "through")
        if new.isEmpty():
            break
        known = known.union(new)
    asked = known.join(chunks.select("key", "idx", "part"), ["key", "idx"])

    def cross(t: pa.Table, q: pa.Table) -> pa.Table:
        out: list[dict] = []
        if t.num_rows and q.num_rows:
            t, asks = t.sort_by("_at"), {}
            for r in q.to_pylist():
                asks.setdefault(r["key"], []).append(r)
            s = _sizes(t)
            for key, a, z in _sections(t):
                rs = asks.get(key, [])
                for r, (left, n) in zip(rs, crossing(s[a:z], budget, [r["entry"] for r in rs]) if rs else [], strict=True):
                    out.append({"key": key, "idx": r["idx"], "entry": r["entry"], "to_idx": r["idx"] + 1, "left": left, "n": n})
        return pa.Table.from_pylist(out, pa.schema([("key", pa.string()), ("idx", pa.int32()), ("entry", pa.int64()), ("to_idx", pa.int32()), ("left", pa.int64()), ("n", pa.int64())]))

    jump = slim.groupBy("_part").cogroup(asked.withColumnRenamed("part", "_part").groupBy("_part")).applyInArrow(cross, "key string, idx int, entry bigint, to_idx int, left bigint, n bigint")
    jump = stored(jump, "jumps")
    found = stored(chunks.filter("idx = 0").select("key", "idx", F.lit(-1).cast("bigint").alias("entry"), F.lit(0).cast("bigint").alias("before")), "entries")
    span = 1
    while span <= longest:
        reached = found.join(jump, ["key", "idx", "entry"]).select("key", F.col("to_idx").alias("idx"), F.col("left").alias("entry"), (F.col("before") + F.col("n")).alias("before"))
        found = stored(found.union(reached.filter(F.col("idx") <= longest)), "entries")
        a, b = jump.alias("a"), jump.alias("b")
        jump = stored(a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.to_idx") == F.col("b.idx")) & (F.col("a.left") == F.col("b.entry"))).select(
            "a.key", "a.idx", "a.entry", "b.to_idx", "b.left", (F.col("a.n") + F.col("b.n")).alias("n")), "jumps")
        span *= 2
    return found.join(chunks.select("key", "idx", "part"), ["key", "idx"]).select("part", "key", "entry", "before")
