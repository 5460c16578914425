"""Fuzzy duplicate passages by collinear chaining (operator 9).

Words (lower case, without punctuation at the ends) make ``seed``-word seeds, of which every run of ``window`` keeps the one of
smallest hash, so a stretch of ``seed + window - 1`` words that two texts share keeps a seed that they share. Five words and
runs of 20 suit passages whose five-word shingles have similarity 0.8: of n words at most one in 44 can then have changed (each takes
five shingles), which leaves a stretch of 24 unchanged.

Each occurrence of a seed, by doc_id (nulls last), row and place, is matched with the first one and with the one before it: at
most two matches each, also for seeds that very many documents share. Matches of a document with another are chained: both
places must rise, words between two matches cost, and a Fenwick tree over places in the other document gives the best
predecessor. Each chain, of one match too, is aligned word by word, beyond its ends too; small differences are bridged, and
alignment starts again at the next match of the chain beyond a larger one. A passage of at least ``LEAST`` words of which
at least ``SIMILAR`` are matched is a repeat; it goes from the later document and stays in the first. A chain of one match is aligned
if the ``window // 2`` words before or after its seed are the same too (16 bits of their hashes): in a common stretch as above one
of its seeds has that.

Unchanged passages are found whatever their seeds were matched with: where all kept seeds of a stretch repeat and alignment
leaves ``LEAST`` words of it, every window of so many words there is hashed, and all but the first occurrence of each go. So no
window of ``LEAST`` words of the input stays whole in two places.

A null text stays null. Rows that repeat doc_id and text are one document and get the same result. Input columns stay.
"""

from __future__ import annotations

import gc
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, column_np, free_names, group_starts, list_array, remove, small_batches, stored, whole_groups

#: Words of a seed, run of seeds that keeps one; words of a passage, share of them that match.
SEED, WINDOW, LEAST, SIMILAR = 5, 20, 50, 0.8
#: Stands for a null doc_id, which no id may equal; the last of all.
NO_ID = (1 << 63) - 1
#: Cost of a word between two matches on either side; words beyond a chain's ends that alignment may add; words that one difference may span
#: (those that a passage of LEAST words may have unmatched).
GAP, MARGIN, BRIDGE = 0.1, 64, 10
#: Words of texts whose seeds are taken at once.
TOGETHER = 1 << 16
_EDGES = ".,;:!?\"'()[]{}<>|*#$%&-"


class _Words(dict):
    """Hashes of words as they are written; a cache that is emptied when it is full."""

    def __missing__(self, w: str) -> int:
        h = self[w] = xxhash.xxh64_intdigest(w.lower().strip(_EDGES).encode("utf-8", "replace"))
        return h


_MEMO = _Words()


def word_hashes(text: str | None) -> np.ndarray:
    if len(_MEMO) > 500_000:
        _MEMO.clear()
    words = (text or "").split()
    return np.fromiter(map(_MEMO.__getitem__, words), np.uint64, len(words))


def _least(h: np.ndarray, window: int) -> np.ndarray:
    """The place of the smallest value in each run of ``window``, the first of equal ones: runs of twice the length from those before."""
    value, at, wide = h, np.arange(len(h)), 1
    while wide < window:
        step = min(wide, window - wide)
        right = value[step:]
        at = np.where(right < value[:-step], at[step:], at[:-step])
        value = np.minimum(value[:-step], right)
        wide += step
    return at


def many_seeds(texts: list[np.ndarray], seed: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts as hashes of their words, at once: text, place, hash and side of the seeds kept, in order.

    A side is 16 bits of a hash of the words before the seed (low) and of those after it (high), so many that of a common stretch of
    ``seed + window - 1`` words one side at least lies in it whole; beyond a text's ends stand zeros.
    """
    reach = window // 2
    gap = np.zeros(max(reach, 1), np.uint64)
    flat = np.concatenate([gap, *(x for t in texts for x in (t, gap)), np.zeros(max(seed, window), np.uint64)])
    n = np.array([len(t) for t in texts], np.int64)
    begin = len(gap) + np.append(0, np.cumsum(n + len(gap))[:-1])
    n = n - seed + 1
    h = np.zeros(len(flat) - seed + 1, np.uint64)
    for j in range(seed):
        h = h * np.uint64(0x9E3779B97F4A7C15) + flat[j : j + len(h)]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    runs = np.where(n >= window, n - window + 1, 0)  # windows that lie in their text
    first = np.repeat(begin - np.append(0, np.cumsum(runs)[:-1]), runs) + np.arange(runs.sum())
    kept = _least(h, window)[first] if len(first) else first
    kept = kept[np.append(True, kept[1:] != kept[:-1])] if len(kept) else kept
    short = np.flatnonzero((n > 0) & (n < window))
    if len(short):
        kept = np.sort(np.append(kept, [b + int(h[b : b + m].argmin()) for b, m in zip(begin[short].tolist(), n[short].tolist(), strict=True)]))
    kept = kept.astype(np.int64)
    side = np.zeros(len(kept), np.uint64)
    for shift, at in ((0, kept - reach), (16, kept + seed)):
        x = np.zeros(len(kept), np.uint64)
        for j in range(reach):
            x = x * np.uint64(0x9E3779B97F4A7C15) + flat[at + j]
        side |= ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)) << np.uint64(shift)
    text = np.searchsorted(begin, kept, "right") - 1
    return text, kept - begin[text], h[kept], side.astype(np.uint32).view(np.int32)


def chains(x: list[int], y: list[int], seed: int = SEED) -> list[list[int]]:
    """Chains of matches (indexes, ascending): ``x`` ascending, both places strictly rising along a chain."""
    if all(map(int.__lt__, x, x[1:])) and all(map(int.__lt__, y, y[1:])):  # the match before is then the best predecessor
        one, total = [[0]], float(seed)
        for i in range(1, len(x)):
            gain = total - GAP * (x[i] - x[i - 1] + y[i] - y[i - 1]) + 2 * GAP * seed
            if gain > 0:
                one[-1].append(i)
            else:
                one.append([i])
            total = seed + max(0.0, gain)
        return one
    rank = {v: i + 1 for i, v in enumerate(sorted(set(y)))}
    size = len(rank)
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (size + 1)
    score, before, waiting = [0.0] * len(x), [-1] * len(x), []
    for i in range(len(x)):
        while waiting and x[waiting[0]] < x[i]:
            j = waiting.pop(0)
            entry, k = (score[j] + GAP * (x[j] + y[j]), j), rank[y[j]]
            while k <= size:
                if entry > tree[k]:
                    tree[k] = entry
                k += k & -k
        best, k = (float("-inf"), -1), rank[y[i]] - 1
        while k:
            if tree[k] > best:
                best = tree[k]
            k -= k & -k
        gain = best[0] - GAP * (x[i] + y[i]) + 2 * GAP * seed
        score[i] = seed + max(0.0, gain)
        before[i] = best[1] if gain > 0 else -1
        waiting.append(i)
    out, used = [], bytearray(len(x))
    for i in sorted(range(len(x)), key=lambda i: -score[i]):
        one = []
        while i >= 0 and not used[i]:
            used[i] = 1
            one.append(i)
            i = before[i]
        if one:
            out.append(one[::-1])
    return out


def _run(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Stretches (place in ``a``, place in ``b``, words) that match, from the start of both, with differences of at most BRIDGE words between."""
    i = j = 0
    out = []
    while True:
        n, begin = min(len(a) - i, len(b) - j), i
        step = 64
        while n:
            m = min(n, step)
            differ = np.flatnonzero(a[i : i + m] != b[j : j + m])
            m = int(differ[0]) if len(differ) else m
            i, j = i + m, j + m
            if len(differ):
                break
            n, step = min(len(a) - i, len(b) - j), step * 4
        if i > begin:
            out.append((begin, j - (i - begin), i - begin))
        # the smallest shift of both sides after which three words match again
        near, far = a[i : i + BRIDGE + 3].tolist(), b[j : j + BRIDGE + 3].tolist()
        three: dict[tuple[int, ...], int] = {}
        for t in range(len(far) - 3, -1, -1):
            three[far[t], far[t + 1], far[t + 2]] = t
        shifts = [(s + t, abs(s - t), s, t) for s in range(len(near) - 2) if (t := three.get((near[s], near[s + 1], near[s + 2]))) is not None]
        if not shifts:
            return out
        _, _, s, t = min(shifts)
        if s == t:  # single words that match between replaced ones
            out += [(i + u, j + u, 1) for u in range(s) if near[u] == far[u]]
        i, j = i + s, j + t


def stretches(a: np.ndarray, b: np.ndarray, x: list[int], y: list[int]) -> list[tuple[int, int, int]]:
    """Matching stretches along a chain of matched places: alignment starts again at each match that the one before did not reach."""
    out: list[tuple[int, int, int]] = []
    i = j = 0  # where the alignment so far ends
    for at, on in zip(x, y, strict=True):
        if at < i or on < j:
            continue
        right = _run(a[at:], b[on:])
        if not right:
            continue
        left = _run(a[i:at][::-1], b[j:on][::-1])
        out += [(at - k - n, on - m - n, n) for k, m, n in reversed(left)]
        out += [(at + k, on + m, n) for k, m, n in right]
        i, j = out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]
    return out


def passages_of(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end) in both texts of each run of stretches, at most BRIDGE words apart, that has LEAST words and the share SIMILAR of them
    matched; where runs overlap their union counts."""
    out: list[tuple[int, int, int, int]] = []
    at = 0
    while at < len(found):
        end = at + 1
        while end < len(found) and max(found[end][0] - sum(found[end - 1][::2]), found[end][1] - sum(found[end - 1][1:])) <= BRIDGE:
            end += 1
        part, at = found[at:end], end
        # each matched word gives 1 - SIMILAR, each other one costs SIMILAR: from each start, the furthest end of no negative sum
        before, after, total, last = [], [], 0.0, None
        for x, y, n in part:
            total -= 0.0 if last is None else SIMILAR * max(x - last[0], y - last[1])
            before.append(total)
            total += (1 - SIMILAR) * n
            after.append(total)
            last = (x + n, y + n)
        best = list(np.maximum.accumulate(after[::-1])[::-1])  # the highest sum at or beyond each end
        e = 0
        for s in range(len(part)):
            e = max(e, s)
            while e + 1 < len(part) and best[e + 1] >= before[s] - 1e-9:
                e += 1
            t = e
            while t > s and after[t] < before[s] - 1e-9:
                t -= 1
            (x, y, _), (x2, y2, n) = part[s], part[t]
            if x2 + n - x < LEAST:
                continue
            if out and x <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], x2 + n), out[-1][2], max(out[-1][3], y2 + n))
            else:
                out.append((x, x2 + n, y, y2 + n))
    return out


def _ident(text: str) -> list[Column]:
    """doc_id (the largest long for null) and a digest of the text, which together know a row."""
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("d"), F.xxhash64(F.col("doc_id").isNull(), F.coalesce(F.col(text), F.lit(""))).alias("k")]


def _seed_rows(docs: DataFrame, text: str, seed: int, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, start, size = [], 0, 0
            for i, t in enumerate(b.column(2).to_pylist()):
                texts.append(word_hashes(t))
                size += len(texts[-1])
                if size >= TOGETHER or i + 1 == b.num_rows:
                    row, at, h, side = many_seeds(texts, seed, window)
                    if len(row):
                        row = pa.array(row + start)
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(0).take(row), b.column(1).take(row), pa.array(at.astype(np.int32)), pa.array(side)], names=["seed", *PLACE])
                    texts, start, size = [], i + 1, 0

    return docs.select(*_ident(text), text).mapInArrow(run, "seed bigint, d bigint, k bigint, pos int, side int")


#: What knows an occurrence, in order; side goes with it (what stands beside it).
PLACE = ("d", "k", "pos", "side")


def _earlier(rows: DataFrame, both: bool) -> tuple[DataFrame, DataFrame]:
    """Each occurrence (d, k, pos) of a ``seed`` but the first, with that one (d2, k2, pos2); with ``both`` also with the one before it, and the
    first one of several with itself. near: whether what stands before or after is equal too.

    Rows are dealt by ranges of (seed, place), so that a seed that very many rows hold lies in several tasks, which follow one
    another. What the tasks tell of the seeds they begin and end with, two rows for each task, meets in the driver: which task's
    first seed began before it, with what place, and what came last before it. Matches with the first one there of such a seed are turned to the first of all by a
    look-up of the task, so the result doesn't depend on the ranges. Also returns the stored table that the matches come from, for its removal.
    """
    match = [*PLACE[:3], *(f"{c}2" for c in PLACE[:3]), "near"]
    schema = "d bigint, k bigint, pos int, d2 bigint, k2 bigint, pos2 int, near boolean, seed bigint, side int, side2 int, part int, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]

        def out(place: list[np.ndarray], one: np.ndarray, two: np.ndarray, head: bool = False, second: bool = False) -> pa.RecordBatch:
            """Matches; those with the first one of the ``head`` seed tell their task and what stands beside them. ``second``: a match with the one before, which is the first
            one here, so it only counts where another task has the first of all."""
            differ = place[3][one] ^ place[3][two]
            near, none = pa.array((differ & 0xFFFF == 0) | (differ >> 16 == 0)), lambda t: pa.nulls(len(one), t)
            return pa.RecordBatch.from_arrays([*(pa.array(c[one]) for c in place[:3]), *(pa.array(c[two]) for c in place[:3]), near, none(pa.int64()), pa.array(place[3][one]), none(pa.int32()), pa.array(np.full(len(one), TaskContext.get().partitionId(), np.int32)) if head else none(pa.int32()), pa.array(np.ones(len(one), np.int64)) if second else none(pa.int64())], names=names)

        def edge(place: list[np.ndarray], seed: np.ndarray, n: int) -> pa.RecordBatch:
            """The first and last place of a seed here; ``n``: its rows here, 0 for the seed that the task begins with."""
            one, two = ([c[i : i + 1] for c in place] for i in (0, len(seed) - 1))
            kinds = [pa.int64(), pa.int64(), pa.int32()]
            told = [*(pa.array(c, t) for c, t in zip(one[:3], kinds, strict=True)), *(pa.array(c, t) for c, t in zip(two[:3], kinds, strict=True)), pa.nulls(1, pa.bool_()), pa.array(seed[:1])]
            return pa.RecordBatch.from_arrays([*told, pa.array(one[3]), pa.array(two[3]), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], names=names)

        carry: list[np.ndarray] = []
        count, started = 0, False  # rows so far of the seed that the carry ends with
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            old = len(carry[0]) if carry else 0
            cols = [np.concatenate(c) for c in zip(carry, cols, strict=True)] if old else cols
            fresh = np.ones(len(cols[0]), bool)  # rows that repeat are one document
            fresh[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            cols = [c[fresh] for c in cols]
            seed, place = cols[0], cols[1:]
            if not started:
                started, head = True, seed[0]
                yield edge([c[:1] for c in place], seed[:1], 0)
            at = np.arange(len(seed))
            new = np.ones(len(seed), bool)
            new[1:] = seed[1:] != seed[:-1]
            first = np.maximum.accumulate(np.where(new, at, 0))
            later = at[(at > first) & (at >= old)]
            one, two, more = later, first[later], later[:0]
            if both:
                more, begin = later[later - 1 > first[later]], first[later[later - 1 == first[later]]]
                one, two = np.concatenate([one, begin]), np.concatenate([two, begin])
            of_head = seed[one] == head
            kinds = [(one[~of_head], two[~of_head], False, False), (one[of_head], two[of_head], True, False), (more, more - 1, False, False)]
            if both:
                second = later[(later - 1 == first[later]) & (seed[later] == head)]
                kinds.append((second, second - 1, True, True))
            for x, y, h, only in kinds:
                if len(x):
                    yield out(place, x, y, h, only)
            tail = len(seed) - max(first[-1], old)
            count = tail if first[-1] >= old else count + tail
            carry = [c[np.unique([first[-1], at[-1]])] for c in cols]
        if carry:
            yield edge(carry[1:], carry[0], count)

    order = ["seed", *PLACE]
    rows = stored(rows.select(*order), "occurrences")  # the ranges are settled on it
    steps = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "steps")
    remove(rows)
    edges = steps.filter("seed is not null").select("part", "seed", "n", F.struct(*PLACE).alias("a"), F.struct(*(f"{c}2" for c in PLACE)).alias("z")).collect()
    ended: dict[int, list] = {}
    for e in sorted((e for e in edges if e.n), key=lambda e: e.part):
        ended.setdefault(e.seed, []).append(e)
    pairs: set[tuple] = set()
    firsts: dict[int, dict] = {}
    for head in (e for e in edges if not e.n):
        before = ended.get(head.seed, [])
        before = before[: bisect_right(before, head.part - 1, key=lambda e: e.part)]
        if before:
            a, h, z = tuple(before[0].a), tuple(head.a), tuple(before[-1].z)
            pairs |= {(h, a), (h, z), (a, a)} if both else {(h, a)}
            firsts[head.part] = dict(zip(("td", "tk", "tpos", "tside"), a, strict=True))
    same = lambda x, y: (x ^ y) & 0xFFFF == 0 or (x ^ y) >> 16 == 0
    told = [(*h[:3], *a[:3], same(h[3], a[3])) for h, a in sorted(pairs)]
    make = steps.sparkSession.createDataFrame
    ends = make(told, "d bigint, k bigint, pos int, d2 bigint, k2 bigint, pos2 int, near boolean")
    # by task: an array with an entry for each, that a row looks into by its task's number
    listed = json.dumps([firsts.get(i) for i in range(max(firsts, default=-1) + 1)])
    true = F.get(F.from_json(F.lit(listed), "array<struct<td: bigint, tk: bigint, tpos: int, tside: int>>"), F.col("part"))
    local = steps.filter("part is not null and seed is null").withColumn("x", true).select("*", "x.*")
    own = (F.col("d") == F.col("d2")) & (F.col("k") == F.col("k2")) & (F.col("pos") == F.col("pos2"))
    differ = F.col("side").bitwiseXOR(F.col("tside"))
    near = F.when(F.col("td").isNull(), F.col("near")).otherwise((differ.bitwiseAND(F.lit(0xFFFF)) == 0) | (F.shiftright(differ, 16) == 0))
    before = local.filter("n is not null and td is not null").select(*match)
    local = local.filter("n is null").filter(F.col("td").isNull() | ~own).select("d", "k", "pos", F.coalesce("td", "d2").alias("d2"), F.coalesce("tk", "k2").alias("k2"), F.coalesce("tpos", "pos2").alias("pos2"), near.alias("near"))
    return steps.filter("part is null").select(*match).union(local).union(before).union(ends), steps


def _ranges(ends: list[tuple[int, int]], seed: int) -> list[tuple[int, int]]:
    """For each first and last place of a chain the range of words to align; ranges that overlap become one."""
    wide = [(max(0, lo - MARGIN), hi + seed + MARGIN) for lo, hi in ends]
    if len(wide) == 1:
        return wide
    merged: list[list[int]] = []
    for lo, hi in sorted(wide):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    begins = [lo for lo, _ in merged]
    return [(m[0], m[1]) for m in (merged[bisect_right(begins, lo) - 1] for lo, _ in wide)]


_CHAINS = "d bigint, k bigint, d2 bigint, k2 bigint, x array<int>, y array<int>, n array<int>, s1 int, e1 int, s2 int, e2 int"


def _chained(matches: DataFrame, seed: int, window: int) -> DataFrame:
    """From matches: chains of two documents as places x and y of their matches, n being the matches of each chain; those whose ranges of
    words to align (s1 to e1, s2 to e2) overlap are one row. A lone match that is not near can be no passage by the similarity of five-word
    shingles, and is left out. With no x, the range of each stretch long enough for a passage in which
    every kept seed repeats."""
    names = [f.split()[0] for f in _CHAINS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["d", "k"]):
            d, k, d2, k2, x, y = (column_np(t, n) for n in ("d", "k", "d2", "k2", "pos", "pos2"))
            head = group_starts(t, ["d", "k"])
            spot = np.unique(((np.searchsorted(head, np.arange(len(k)), "right") - 1) << 32) + x)
            ends = np.flatnonzero(np.append(np.diff(spot) > window, True))
            begins = np.append(0, ends[:-1] + 1)
            lo, hi = (spot[begins] & 0xFFFFFFFF) - window + 1, (spot[ends] & 0xFFFFFFFF) + seed + window - 1
            wide = hi - np.maximum(lo, 0) >= LEAST
            cover = np.stack([np.maximum(lo, 0), hi], axis=1)[wide]
            if len(cover):
                own, empty = head[spot[begins] >> 32][wide], pa.nulls(len(cover), pa.list_(pa.int32()))
                place = [pa.array(c.astype(np.int32)) for c in cover.T]
                yield pa.RecordBatch.from_arrays([pa.array(d[own]), pa.array(k[own]), pa.array(d[own]), pa.array(k[own]), empty, empty, empty, *place, *place], names=names)
            other = np.flatnonzero((d != d2) | (k != k2) | (x != y))
            t = t.take(pa.array(other))
            if not t.num_rows:
                continue
            starts = [*group_starts(t, ["d", "k", "d2", "k2"]).tolist(), t.num_rows]
            d, k, d2, k2, x, y = (c[other] for c in (d, k, d2, k2, x, y))
            xs, ys, near_ = x.tolist(), y.tolist(), column_np(t, "near").tolist()
            rows: list[tuple[int, ...]] = []
            every: list[int] = []
            sizes: list[int] = []
            chains_in: list[int] = []
            counts: list[int] = []
            for s, e in zip(starts, starts[1:], strict=False):
                near: dict[tuple[int, ...], list[list[int]]] = {}
                if e == s + 1 and not near_[s]:
                    continue
                found = [[s + i for i in c] for c in chains(xs[s:e], ys[s:e], seed)]
                found = [c for c in found if len(c) > 1 or near_[c[0]]]
                for c, one, two in zip(found, _ranges([(xs[c[0]], xs[c[-1]]) for c in found], seed), _ranges([(ys[c[0]], ys[c[-1]]) for c in found], seed), strict=True):
                    near.setdefault((*one, *two), []).append(c)
                for where, some in near.items():
                    rows.append((s, *where))
                    counts.append(len(some))
                    chains_in += [len(c) for c in some]
                    sizes.append(sum(len(c) for c in some))
                    for c in some:
                        every += c
            if not rows:
                continue
            lead, *where = np.array(rows).T
            lists = [list_array(v, n, pa.int32()) for v, n in ((x[every], sizes), (y[every], sizes), (np.array(chains_in, np.int32), counts))]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[lead]) for c in (d, k, d2, k2)), *lists, *(pa.array(v.astype(np.int32)) for v in where)], names=names)

    return matches.repartition("d", "k").sortWithinPartitions("d", "k", "d2", "k2", "pos", "pos2").mapInArrow(run, _CHAINS)


def window_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of each run of LEAST words."""
    n = len(words) - LEAST + 1
    if n < 1:
        return np.empty(0, np.uint64)
    factor, h, done, out = 0x9E3779B97F4A7C15, words, 0, np.zeros(n, np.uint64)
    for bit in range(LEAST.bit_length()):  # h: hashes of runs of 2 ** bit words
        if LEAST >> bit & 1:
            out = out * np.uint64(factor) + h[done : done + n]
            done += 1 << bit
        if LEAST >> bit == 1:
            break
        h = h[: len(h) - (1 << bit)] * np.uint64(factor) + h[1 << bit :]
        factor = factor * factor & (2**64 - 1)
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column without nulls, as views."""
    values, at = column.values.to_numpy(), column.offsets.to_pylist()
    return [values[i:j] for i, j in zip(at, at[1:], strict=False)]


def _ranges_of(column: pa.ListArray) -> list[list[tuple[int, int]]]:
    """The lists of a column of (s, e) without nulls."""
    s, e = (column.values.field(n).to_pylist() for n in ("s", "e"))
    at = column.offsets.to_pylist()
    return [list(zip(s[i:j], e[i:j], strict=True)) for i, j in zip(at, at[1:], strict=False)]


def _with_texts(docs: DataFrame, ranges: DataFrame, text: str) -> DataFrame:
    """d, k, t (the text, null as empty) and r (its ranges) of the rows that have some of ``ranges`` (d, k, s, e); rows that repeat lend their text once."""
    wanted = ranges.distinct().groupBy("d", "k").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("r"))
    texts = docs.select(*_ident(text), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return texts.join(wanted, ["d", "k"]).groupBy("d", "k").agg(F.min("t").alias("t"), F.first("r").alias("r"))


def _slices(docs: DataFrame, ranges: DataFrame, text: str) -> DataFrame:
    """Of ranges (d, k, s, e) of words, cut to the text: w, half of each word's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, s, e, got = [], [], [], []
            for i, (t, r) in enumerate(zip(b.column(2).to_pylist(), _ranges_of(b.column(3)), strict=True)):
                w = word_hashes(t).astype(np.uint32).view(np.int32)
                for lo, hi in r:
                    row.append(i)
                    s.append(lo)
                    e.append(hi)
                    got.append(w[lo:hi])
            if row:
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(s, pa.int32()), pa.array(e, pa.int32()), list_array(np.concatenate(got), [len(g) for g in got], pa.int32())], names=["d", "k", "s", "e", "w"])

    return _with_texts(docs, ranges, text).mapInArrow(run, "d bigint, k bigint, s int, e int, w array<int>")


def _windows(docs: DataFrame, ranges: DataFrame, text: str) -> DataFrame:
    """A row for each window of LEAST words in ranges of words, its hash as seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at, got = [], [], []
            for i, (t, r) in enumerate(zip(b.column(2).to_pylist(), _ranges_of(b.column(3)), strict=True)):
                w = word_hashes(t)
                for lo, hi in r:
                    h = window_hashes(w[lo:hi])
                    row.append(np.full(len(h), i))
                    at.append(np.arange(lo, lo + len(h), dtype=np.int32))
                    got.append(h)
            if got and sum(map(len, got)):
                own = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64)), b.column(0).take(own), b.column(1).take(own), pa.array(np.concatenate(at)), pa.array(np.zeros(len(own), np.int32))], names=["seed", *PLACE])

    return _with_texts(docs, ranges, text).mapInArrow(run, "seed bigint, d bigint, k bigint, pos int, side int")


def _merged(spans: DataFrame, stretches: DataFrame | None = None) -> DataFrame:
    """Spans (d, k, s, e) with those that overlap or touch made one; given ``stretches``, instead what spans leave of them in LEAST words or more."""

    leave = stretches is not None

    def union(s: np.ndarray, e: np.ndarray) -> list[tuple[int, int]]:
        reach = np.maximum.accumulate(e)
        cut = np.flatnonzero(np.append(True, s[1:] > reach[:-1]))
        return list(zip(s[cut].tolist(), reach[np.append(cut[1:], len(s)) - 1].tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["d", "k"]):
            s, e, kind = (column_np(t, n) for n in ("s", "e", "kind"))
            heads = [*group_starts(t, ["d", "k"]).tolist(), t.num_rows]
            row, lo, hi = [], [], []
            for a, z in zip(heads, heads[1:], strict=False):
                gone = kind[a:z] == 0
                out = union(s[a:z][gone], e[a:z][gone]) if gone.any() else []
                if not gone.all():
                    edges = [0, *(x for pair in out for x in pair), 1 << 30]
                    free = list(zip(edges[::2], edges[1::2], strict=True))
                    out = [(max(x, p), min(y, q)) for p, q in union(s[a:z][~gone], e[a:z][~gone]) for x, y in free if min(y, q) - max(x, p) >= LEAST]
                elif leave:
                    out = []
                row += [a] * len(out)
                lo += [x for x, _ in out]
                hi += [y for _, y in out]
            if row:
                d, k = column_np(t, "d"), column_np(t, "k")
                yield pa.RecordBatch.from_arrays([pa.array(d[row]), pa.array(k[row]), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["d", "k", "s", "e"])

    rows = spans.select("d", "k", "s", "e", F.lit(0).alias("kind"))
    if leave:
        rows = rows.union(stretches.select("d", "k", "s", "e", F.lit(1)))
    return rows.repartition("d", "k").sortWithinPartitions("d", "k", "s").mapInArrow(run, "d bigint, k bigint, s int, e int")


def _release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs that are over: it does when the driver's JVM collects what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _aligned(passages: DataFrame, words: DataFrame, reach: int) -> DataFrame:
    """Spans (d, k, s, e) to remove by aligning chains, the best first. A chain inside a passage that goes already, by ``reach`` words on either side, is
    left out: what agrees beyond has seeds of its own."""
    mine = words.select("d", "k", F.col("s").alias("s1"), F.col("e").alias("e1"), F.col("w").alias("w1"))
    other = words.select(F.col("d").alias("d2"), F.col("k").alias("k2"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("w").alias("w2"))
    own = (F.col("d") == F.col("d2")) & (F.col("k") == F.col("k2"))
    both = passages.join(mine, ["d", "k", "s1", "e1"]).join(other, ["d2", "k2", "s2", "e2"]).select("d", "k", "s1", "s2", "x", "y", "n", own.alias("own"), "w1", "w2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, s, e = [], [], []
            s1_, s2_, own_ = (b.column(j).to_pylist() for j in (2, 3, 7))
            x_, y_, n_, w1, w2 = (_lists(b.column(j)) for j in (4, 5, 6, 8, 9))
            for i, (s1, s2, x, y, n, own, one, two) in enumerate(zip(s1_, s2_, x_, y_, n_, own_, w1, w2, strict=True)):
                x, y, at = x.tolist(), y.tolist(), 0
                gone: list[tuple[int, int]] = []
                for size in n.tolist():
                    mine, at = [p - s1 for p in x[at : at + size]], at + size
                    low, high = max(0, mine[0] - reach), min(len(one), mine[-1] + reach)
                    if any(lo <= low and high <= hi for lo, hi in gone):
                        continue
                    found = stretches(one, two, mine, [p - s2 for p in y[at - size : at]])
                    for lo, hi, _, hi2 in passages_of(found):
                        if own:
                            lo = max(lo, hi2 + s2 - s1)  # a passage that overlaps its own first occurrence starts after it
                            if hi - lo < LEAST:
                                continue
                        gone.append((lo, hi))
                        row.append(i)
                        s.append(lo + s1)
                        e.append(hi + s1)
            if row:
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["d", "k", "s", "e"])

    return both.mapInArrow(run, "d bigint, k bigint, s int, e int")


def repeated_passages(docs: DataFrame, text: str = "text", seed: int = SEED, window: int = WINDOW) -> DataFrame:
    """(d, k, spans): for each row (as ``_ident`` knows it) the word ranges (s, e) to remove."""
    spark = docs.sparkSession
    small_batches(spark)
    matches, steps = _earlier(_seed_rows(docs, text, seed, window), both=True)
    found = stored(_chained(matches, seed, window), "chains")
    remove(steps)
    _release(spark)
    passages = found.filter("x is not null")
    wanted = passages.select("d", "k", F.col("s1").alias("s"), F.col("e1").alias("e")).union(passages.select("d2", "k2", "s2", "e2"))
    words = stored(_slices(docs, wanted, text), "slices")
    _release(spark)
    spans = stored(_aligned(passages, words, seed + window), "aligned")
    remove(words)
    _release(spark)
    left = stored(_merged(spans, found.filter("x is null").select("d", "k", F.col("s1").alias("s"), F.col("e1").alias("e"))), "left")
    again, steps = _earlier(_windows(docs, left, text), both=False)
    # a window that overlaps its own first occurrence starts after it
    start = F.when((F.col("d") == F.col("d2")) & (F.col("k") == F.col("k2")), F.greatest("pos", F.col("pos2") + LEAST)).otherwise(F.col("pos"))
    exact = again.select("d", "k", start.alias("s"), (F.col("pos") + LEAST).alias("e")).filter("s < e")
    out = stored(_merged(spans.union(exact)).groupBy("d", "k").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans")), "spans")
    remove(found, spans, left, steps)
    _release(spark)
    return out


def dedup_passages(docs: DataFrame, text: str = "text", seed: int = SEED, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``text`` rewritten, and n_words, n_removed (words) and n_spans added; columns of these names are replaced, all others stay.

    Shorter and denser seeds (4 and 6) find passages with more changed words, for twice to three times the work.
    """
    d, k, spans = free_names(docs, "d", "k", "spans")
    found = repeated_passages(docs, text, seed, window).select(F.col("d").alias(d), F.col("k").alias(k), F.col("spans").alias(spans))
    rows = docs.withColumns(dict(zip((d, k), _ident(text), strict=True))).join(found, [d, k], "left")

    def make(b: pa.RecordBatch) -> dict[str, pa.Array]:
        texts, ranges = (b.column(b.schema.get_field_index(c)).to_pylist() for c in (text, spans))
        kept, words, gone, runs = [], [], [], []
        for t, x in zip(texts, ranges, strict=True):
            merged = [(r["s"], r["e"]) for r in x or ()]
            words.append(len((t or "").split()))
            gone.append(sum(hi - lo for lo, hi in merged))
            runs.append(len(merged))
            if merged:
                at = [m.span() for m in WORDS(t)]
                cut = [0, *(c for lo, hi in merged for c in (at[lo][0], at[hi - 1][1])), len(t)]
                t = "".join(t[a:z] for a, z in zip(cut[::2], cut[1::2], strict=True))
            kept.append(t)
        return {text: pa.array(kept, pa.string()), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(runs, pa.int64())}

    out = add_columns(rows, make, f"`{text}` string, n_words bigint, n_removed bigint, n_spans bigint", drop=[spans, d, k])
    return out.select(*docs.drop("n_words", "n_removed", "n_spans").columns, "n_words", "n_removed", "n_spans")


#: As str.split() parts words.
WORDS = re.compile(r"[^\s\x1c-\x1f\x85]+").finditer


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: per document the counts and a digest of the text kept."""
    rows = dedup_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", "n_spans", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))
