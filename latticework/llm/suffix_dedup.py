"""Exact duplicate passages by suffix arrays (operator 5).

Removes each byte covered by a string of ``LENGTH`` bytes that also starts anywhere else, in another document or in the same.

A window of that length is known by its anchor: of its k-grams the one of smallest hash, the first such. Equal windows
have equal anchors at the same place, so only windows around k-grams that are anchors more than once can repeat. Each
anchor's context is all that the windows with it can hold. Anchors and contexts travel as hashes, with counts that are
combined before the shuffle: a context that occurs twice is covered whole, and an anchor whose contexts are all equal is
settled without its bytes. For the rest, the distinct contexts of an anchor meet in a task, which sorts suffixes of
them by linear grouping (``suffix_sort``), as blocks and then, around equal blocks, as bytes: windows that repeat are neighbours
in that order. An anchor with more than ``LARGE`` distinct contexts
is no task's group: its windows are hashed (128 bits) and counted over the cluster instead, one row for each window.

Texts are UTF-8 bytes; a null text counts as empty. What occurs is judged on the input. Rows are known by doc_id
and a hash of the text; null ids are allowed, and rows that repeat both count as two occurrences and get one result. Other
columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, column_np, free_names, group_starts, remove, small_batches, stored, whole_groups
from .suffix_sort import suffix_array

#: Bytes of a window, of a k-gram, and of a block; distinct contexts of an anchor that one task sorts; bytes hashed at once.
LENGTH, GRAM, BLOCK, LARGE, CHUNK = 200, 32, 20, 32768, 1 << 20
#: Whole blocks that every window holds, wherever it begins.
CORE_BLOCKS = LENGTH // BLOCK - 1
#: An anchor that more rows have is joined by a broadcast of such anchors: so many rows, or that share of all, so they are few.
HOT_ROWS, HOT_SHARE = 4096, 1000
#: Stands for a null doc_id, which no id may equal.
NO_ID = -(1 << 63)
CORE = "\u0100"  # beyond all bytes
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256).astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any slices of a byte array."""

    def __init__(self, data: np.ndarray, base: int = 0) -> None:
        n, b = len(data), _BASE[base]
        if base not in _POWERS or len(_POWERS[base][0]) < n + 1:
            size = max(n, CHUNK) + 1
            up, down = np.full(size, b, np.uint64), np.full(size, pow(b, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            _POWERS[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        up, self.down = _POWERS[base]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in one byte array: the text, place in the array, hash and context hash of each anchor."""
    n, span = len(data), LENGTH - GRAM + 1  # a window has so many k-grams
    long = ends - starts >= LENGTH
    starts, ends, row = starts[long], ends[long], np.flatnonzero(long)
    if not len(starts):
        return tuple(np.empty(0, np.int64) for _ in range(4))
    h = Hashes(data)
    at = np.arange(n - GRAM + 1)
    gram = h.of(at, at + GRAM)
    place = np.uint64((1 << 26) - 1)
    # the place breaks ties between equal hashes: the first; arrays beyond 2**26 bytes are a single text, where any fixed rule does
    key = (gram & ~place) | (at.astype(np.uint64) & place) if n <= 1 << 26 else gram
    pad = np.full(-(-len(key) // span) * span + span, np.iinfo(np.uint64).max, np.uint64)
    pad[: len(key)] = key
    blocks = pad.reshape(-1, span)
    first = np.minimum.accumulate(blocks, axis=1).ravel()
    last = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = np.concatenate([np.arange(a, z - LENGTH + 1) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)])
    low = np.minimum(last[windows], first[windows + span - 1])
    if n <= 1 << 26:
        chosen = np.unique(low & place).astype(np.int64)
    else:
        chosen = np.flatnonzero(np.isin(gram, np.unique(low)))
    text = np.searchsorted(starts, chosen, "right") - 1
    context = h.of(np.maximum(starts[text], chosen - (LENGTH - GRAM)), np.minimum(ends[text], chosen + LENGTH))
    shape = np.minimum(chosen - starts[text], LENGTH - GRAM) * 1000 + np.minimum(ends[text] - chosen, LENGTH)
    return row[text], chosen, gram[chosen].view(np.int64), _mix(context + shape.astype(np.uint64)).view(np.int64)


def repeated(contexts: list[tuple[int, bytes, int, int]]) -> list[tuple[int, int] | None]:
    """For contexts, each (anchor, bytes, anchor's place in them, occurrences), those of one anchor distinct: the first and the end
    byte, from the anchor, that repeated windows cover.

    Contexts are cut into blocks of ``BLOCK`` bytes counted from the anchor, each a symbol known by its anchor, place and bytes, and the
    suffixes of all contexts as one string of symbols are sorted. A window is ``CORE_BLOCKS`` whole blocks and ``BLOCK`` bytes around them;
    so contexts that share one are neighbours in that order, with so many equal symbols. Where what lies around the blocks is equal
    too, each window with them repeats. The rest differs in a few bytes on either side: the blocks become one symbol, and the suffixes
    of these short strings are sorted.
    """
    out: list[tuple[int, int] | None] = [(-a, len(c) - a) if n > 1 else None for _, c, a, n in contexts]
    number: dict[tuple[int, int, bytes], int] = {}
    string, owner, column = [], [], []
    for i, (key, c, a, _) in enumerate(contexts):
        first = -(a // BLOCK)
        for col in range(first, (len(c) - a) // BLOCK):
            at = a + col * BLOCK
            string.append(number.setdefault((key, col, c[at : at + BLOCK]), len(number)))
            owner.append(i)
            column.append(col)
    if len(string) < CORE_BLOCKS:
        return out
    order = np.array(suffix_array(string))
    symbols, own, col = np.array(string), np.array(owner), np.array(column)
    begins = order[order <= len(string) - CORE_BLOCKS]
    begins = begins[(own[begins] == own[begins + CORE_BLOCKS - 1]) & (col[begins] <= 0) & (col[begins] >= -((LENGTH - GRAM) // BLOCK))]
    if not len(begins):
        return out
    blocks = np.lib.stride_tricks.sliding_window_view(symbols, CORE_BLOCKS)[begins]
    heads = np.flatnonzero(np.append(True, (blocks[1:] != blocks[:-1]).any(1)))
    for s, e in zip(heads.tolist(), [*heads[1:].tolist(), len(begins)], strict=True):
        if e - s > 1:
            _settle(contexts, out, own[begins[s:e]].tolist(), -int(col[begins[s]]) * BLOCK)
    return out


def _settle(contexts: list[tuple[int, bytes, int, int]], out: list[tuple[int, int] | None], same: list[int], lo: int) -> None:
    """Widen ``out`` for the contexts ``same``, which share the blocks that begin ``lo`` bytes before the anchor, by the windows with these blocks."""
    hi = min(lo + BLOCK - 1, LENGTH - GRAM)

    def cover(i: int, most: int, least: int) -> None:
        """Windows that begin ``least`` to ``most`` bytes before the anchor repeat."""
        begin, end = out[i] or (-most, LENGTH - least)
        out[i] = (min(begin, -most), max(end, LENGTH - least))

    open_ = {i for i in same if not (out[i] and out[i][0] <= -hi and out[i][1] >= LENGTH - lo)}
    if not open_:
        return
    short: dict[tuple[bytes, bytes], list[int]] = {}
    for i in same:
        _, c, a, _ = contexts[i]
        short.setdefault((c[max(0, a - hi) : a - lo], c[a - lo + CORE_BLOCKS * BLOCK : a - lo + LENGTH]), []).append(i)
    for (left, right), own in short.items():
        most, least = lo + len(left), lo + BLOCK - len(right)
        if len(own) > 1 and most >= least:
            for i in own:
                cover(i, most, least)
    if len(short) > 1 and any(len(own) == 1 and own[0] in open_ for own in short.values()):
        for (left, right), most, least in _shared_windows(list(short), BLOCK):
            for i in short[left, right]:
                cover(i, lo + most, lo + least)


def _shared_windows(strings: list[tuple[bytes, bytes]], reach: int) -> Iterator[tuple[tuple[bytes, bytes], int, int]]:
    """Of distinct (bytes before, bytes after) a common core: those that share a window (``reach`` bytes besides the core), with the most and the least bytes before the core of such windows."""
    text: list[int] = []
    owner: list[tuple[int, int]] = []
    full = [left.decode("latin-1") + CORE + right.decode("latin-1") for left, right in strings]
    for j, x in enumerate(full):
        text += [ord(ch) + len(full) for ch in x]
        text.append(j)  # ends a string: no two are alike
        owner += [(j, p) for p in range(len(x) + 1)]
    found: dict[int, list[int]] = {}
    window, first = None, (-1, 0)
    for at in suffix_array(text):
        j, p = owner[at]
        before = len(strings[j][0]) - p
        if before < 0 or len(full[j]) - p < reach + 1:
            continue
        if (w := full[j][p : p + reach + 1]) != window:
            window, first = w, (j, before)
            continue
        for k in (first[0], j):
            found.setdefault(k, []).append(before)
    for j, places in found.items():
        yield strings[j], max(places), min(places)


def _texts(b: pa.RecordBatch, name: str) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in b.column(b.schema.get_field_index(name)).to_pylist()]


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """k1, k2, text: a row is known by its doc_id and a hash of its text; rows that repeat both are alike."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("k1"), F.xxhash64(F.col("doc_id").isNull(), t).alias("k2"), t.alias("text"))


def _anchor_rows(keyed: DataFrame) -> DataFrame:
    """k1, k2, pos (in bytes), room (bytes from the anchor to the text's end, at most LENGTH), akey, ctx."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, at = _texts(b, "text"), 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                    size += len(texts[end])
                    end += 1
                ends = np.cumsum([len(t) for t in texts[at:end]])
                starts = ends - [len(t) for t in texts[at:end]]
                row, place, key, ctx = anchors(np.frombuffer(b"".join(texts[at:end]), np.uint8), starts, ends)
                if len(row):
                    own = pa.array(row + at)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), pa.array((place - starts[row]).astype(np.int32)), pa.array(np.minimum(ends[row] - place, LENGTH).astype(np.int32)), pa.array(key), pa.array(ctx)], names=["k1", "k2", "pos", "room", "akey", "ctx"])
                at = end

    return keyed.mapInArrow(run, "k1 bigint, k2 bigint, pos int, room int, akey bigint, ctx bigint")


def _cut_contexts(rows: DataFrame) -> DataFrame:
    """From text and needs (pos, akey, ctx, n): akey, ctx, n, a (the anchor's place in the context), c (its bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for t, needs in zip(_texts(b, "text"), b.column(b.schema.get_field_index("needs")).to_pylist(), strict=True):
                for x in needs:
                    lo = max(0, x["pos"] - (LENGTH - GRAM))
                    out.append((x["akey"], x["ctx"], x["n"], x["pos"] - lo, t[lo : x["pos"] + LENGTH], x["large"]))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()), strict=True)], names=["akey", "ctx", "n", "a", "c", "large"])

    return rows.mapInArrow(run, "akey bigint, ctx bigint, n bigint, a int, c binary, large boolean")


def _sorted_spans(contexts: DataFrame) -> DataFrame:
    """akey, ctx, lo, hi of contexts by the suffix arrays of their anchors' groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["akey"]):
            starts = [*group_starts(t, ["akey"]).tolist(), t.num_rows]
            key, ctx, n, a, c = (column_np(t, "akey"), column_np(t, "ctx"), column_np(t, "n").tolist(), column_np(t, "a").tolist(), t.column("c").to_pylist())
            at, lo, hi, group = [], [], [], key.tolist()
            for s, e in _bundles(starts):
                for i, span in enumerate(repeated(list(zip(group[s:e], c[s:e], a[s:e], n[s:e], strict=True))), s):
                    if span:
                        at.append(i)
                        lo.append(span[0])
                        hi.append(span[1])
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(ctx[at]), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["akey", "ctx", "lo", "hi"])

    return contexts.drop("large").repartition("akey").sortWithinPartitions("akey", "ctx").mapInArrow(run, "akey bigint, ctx bigint, lo int, hi int")


def _bundles(starts: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold whole groups, some hundred rows where groups are small: these are sorted as one string."""
    begin = starts[0]
    for at, end in zip(starts[1:], [*starts[2:], None], strict=True):
        if at - begin >= 256 or end is None:
            yield begin, at
            begin = at


def _counted_spans(contexts: DataFrame) -> DataFrame:
    """The same for anchors with very many distinct contexts, by counting the hashes of all their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c, a = b.column(4).to_pylist(), b.column(3).to_pylist()
            base, first, row, off = 0, [], [], []
            for i, (x, p) in enumerate(zip(c, a, strict=True)):
                w = np.arange(0, min(p, len(x) - LENGTH) + 1)
                w = w[w >= p - (LENGTH - GRAM)]
                first.append(w + base)
                off.append(w - p)
                row.append(np.full(len(w), i))
                base += len(x)
            data, first, row, off = np.frombuffer(b"".join(c), np.uint8), np.concatenate(first), np.concatenate(row), np.concatenate(off)
            h = [Hashes(data, k).of(first, first + LENGTH).view(np.int64) for k in (0, 1)]
            take = lambda k: b.column(k).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), take(0), take(1), take(2), pa.array(off.astype(np.int32))], names=["h1", "h2", "akey", "ctx", "n", "lo"])

    windows = contexts.mapInArrow(run, "h1 bigint, h2 bigint, akey bigint, ctx bigint, n bigint, lo int")
    again = windows.groupBy("h1", "h2", "lo").agg(F.sum("n").alias("c")).filter("c > 1").select("h1", "h2", "lo")
    return windows.join(again, ["h1", "h2", "lo"]).groupBy("akey", "ctx").agg(F.min("lo").alias("lo"), (F.max("lo") + LENGTH).alias("hi"))


def _spans(keyed: DataFrame) -> DataFrame:
    """(k1, k2, spans): for each row key the byte ranges (s, e) that repeated windows cover, not yet merged."""
    rows = stored(_anchor_rows(keyed), "anchors")
    again = stored(rows.groupBy("akey").agg(F.count("*").alias("c"), (F.min("ctx") == F.max("ctx")).alias("same")).filter("c > 1"), "again")
    limit = max(HOT_ROWS, rows.count() // HOT_SHARE)
    hot = F.broadcast(again.filter(F.col("c") > limit).select("akey", "same"))  # at most HOT_SHARE rows
    rest = rows.join(hot.select("akey"), "akey", "left_anti").join(again.filter(F.col("c") <= limit).select("akey", "same"), "akey")
    hits = stored(rows.join(hot, "akey").unionByName(rest), "hits")
    remove(rows, again)
    mixed = hits.filter(~F.col("same"))
    kinds = stored(mixed.groupBy("akey", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "pos")).alias("at")), "kinds")
    large = kinds.groupBy("akey").count().filter(F.col("count") > LARGE).select("akey")
    some = not large.isEmpty()  # else the plan has no part for them
    marked = kinds.join(large.withColumn("large", F.lit(True)), "akey", "left") if some else kinds.withColumn("large", F.lit(False))
    needs = marked.groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct("at.pos", "akey", "ctx", "n", F.coalesce("large", F.lit(False)).alias("large"))).alias("needs"))
    contexts = _cut_contexts(keyed.join(needs, ["k1", "k2"]))
    spans = _sorted_spans(contexts.filter(~F.col("large")))
    if some:
        spans = spans.union(_counted_spans(contexts.filter("large")))
    whole = hits.filter("same").select("k1", "k2", (F.col("pos") - F.least("pos", F.lit(LENGTH - GRAM))).alias("s"), (F.col("pos") + F.col("room")).alias("e"))
    part = mixed.join(spans.distinct(), ["akey", "ctx"]).select("k1", "k2", (F.col("pos") + F.col("lo")).alias("s"), (F.col("pos") + F.col("hi")).alias("e"))
    return whole.union(part).groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def merge(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def mark_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with removed: an array of the byte ranges (s, e) of ``text`` to remove, ascending and apart; a column of that name is replaced, all others stay."""
    small_batches(docs.sparkSession)
    k1, k2, found = free_names(docs, "k1", "k2", "spans")
    spans = _spans(_keyed(docs, text)).toDF(k1, k2, found)
    t = F.coalesce(F.col(text), F.lit(""))
    keys = {k1: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)), k2: F.xxhash64(F.col("doc_id").isNull(), t)}
    return _merged(docs.withColumns(keys).join(spans, [k1, k2], "left"), found).drop(k1, k2)


def _merged(rows: DataFrame, spans: str = "spans") -> DataFrame:
    kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    make = lambda b: {"removed": pa.array([[{"s": s, "e": e} for s, e in merge(x)] for x in b.column(b.schema.get_field_index(spans)).to_pylist()], kind)}
    return add_columns(rows, make, "removed array<struct<s: bigint, e: bigint>>", drop=[spans])


def kept_bytes(data: bytes, removed: list[dict]) -> bytes:
    ends = [0, *(x["e"] for x in removed)]
    return b"".join(data[a:z] for a, z in zip(ends, [*(x["s"] for x in removed), len(data)], strict=True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: per document what goes and a digest of what stays."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    keyed = _keyed(docs, "text")
    # the same columns as where contexts are cut, so Spark shuffles the texts once for both joins
    rows = _merged(keyed.join(_spans(keyed), ["k1", "k2"], "left"))

    def make(b: pa.RecordBatch) -> dict[str, pa.Array]:
        texts, gone = _texts(b, "text"), b.column(b.schema.get_field_index("removed")).to_pylist()
        return {
            "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            "n_removed": pa.array([sum(x["e"] - x["s"] for x in g) for g in gone], pa.int64()),
            "n_spans": pa.array([len(g) for g in gone], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(kept_bytes(t, g)).hexdigest() for t, g in zip(texts, gone, strict=True)]),
        }

    out = add_columns(rows, make, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", drop=["text", "removed"])
    return out.select(F.nullif("k1", F.lit(NO_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
