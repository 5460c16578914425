"""Near-duplicates by SimHash (operator 2).

A text's fingerprint has a bit set where more than half of the hashes of its word shingles have it. Fingerprints
link at ``distance`` or fewer differing bits. They are split into blocks; with at least ``agree`` blocks sure to be
equal for every such pair (pigeonhole), each choice of ``agree`` blocks is a key, rows are dealt by key, and the
Hamming distance is verified among those that share one. Equal fingerprints are one row from the start. Inside a key
only a spanning forest of the links leaves the task: enough for components, and linear in the group's size. A key that
more than ``tile`` fingerprints share is dealt as pairs of tiles to many tasks, so every pair still meets.

With more bits than the pigeonhole bound covers (``Plan.by_similarity``) keys are samples of bits, whose width grows with the
logarithm of the number of fingerprints, so that a key holds few unlike ones in a table of any size; the chance that a close
pair shares none is what the number of keys is chosen for. There fingerprints only propose links. What these connect is a
family, and within a family every two shingle sets are compared, so no rejected link hides one that counts (``similar_links``).

A null text counts as empty; a text without words has fingerprint zero, linked like any other. Rows that repeat get
the same result. A null doc_id keeps its row; it links others but is never the smallest id (a component of null ids
alone has a null component_id). An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, binary_rows, column_np, components, free_names, group_starts, list_array, remove, small_batches, stored, text_key, to_binary, whole_groups

SEED = 42
#: Distinct fingerprints of one key that a task compares at once.
TILE = 2048
#: Distinct shingles, all sets together, that a task compares at once on either side.
TILE_SHINGLES = 2_000_000
#: Chance that a pair of the least similarity, with its mean number of differing bits, shares no key.
MISSED = 0.01
#: Bits of a fingerprint that travel with its keys.
PREVIEW = 40
#: Rows of a key up to which each is compared with each by these bits; larger keys go on as they are.
FEW = 32


def _differ(similarity: float) -> float:
    """Chance that a bit differs between shingle sets of that Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


@dataclass(frozen=True)
class Plan:
    """What makes two documents near-duplicates, and the blocks by which close fingerprints meet."""

    words: int = 3
    bits: int = 64
    distance: int = 3
    widths: tuple[int, ...] = (13, 13, 13, 13, 12)
    agree: int = 2
    tile: int = TILE

    similarity: float = 0.0

    @staticmethod
    def by_similarity(words: int = 5, similarity: float = 0.8, bits: int = 512, block: int = 14, slack: float = 3.0) -> Plan:
        """Shingle sets of Jaccard similarity s have cosine 2s / (1 + s), and each bit differs with chance angle / pi: the distance
        is that mean plus ``slack`` standard deviations, which 0.999 of the pairs at ``similarity`` keep within. Keys have ``block``
        bits at least (``sampled_bits``)."""
        p = _differ(similarity)
        return Plan(words, bits, int(bits * p + slack * math.sqrt(bits * p * (1 - p))), (block,) * (bits // block), 1, similarity=similarity)


def shingles(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words; a shorter text is one run."""
    w = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z and ASCII white space only
    if not w:
        return np.empty(0, np.uint64)
    n = max(1, len(w) - words + 1)
    flat, digest = b" ".join(w), xxhash.xxh64_intdigest
    ends = np.cumsum([len(x) + 1 for x in w])
    begin = np.concatenate([[0], ends[:-1]])[:n].tolist()
    return np.fromiter((digest(flat[a : b - 1], SEED) for a, b in zip(begin, ends[min(words, len(w)) - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprints(texts: list[str | None] | list[np.ndarray], words: int, bits: int) -> np.ndarray:
    """One row of bits / 8 bytes for each text (or its shingles), most significant bit first; hash t of a shingle beyond the first 64 bits is a mix of its XXH64."""
    out = np.zeros((len(texts), bits), np.uint8)
    for i, text in enumerate(texts):
        h = text if isinstance(text, np.ndarray) else shingles(text, words)
        total = np.zeros(bits, np.int64)
        for part in range(0, len(h), 255):  # so many bits sum to a byte
            x = h[part : part + 255]
            mixed = np.stack([_mix(x, t) for t in range(bits // 64)], axis=1).astype(">u8")
            total += _SPREAD[mixed.view(np.uint8).reshape(len(x), -1)].sum(0, dtype=np.uint64).view(np.uint8)
        out[i] = 2 * total > len(h)
    return np.packbits(out, axis=1)


#: A byte's bits, most significant first, as the eight bytes of a word.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _mix(h: np.ndarray, t: int) -> np.ndarray:
    if not t:
        return h
    x = h + np.uint64((0x9E3779B97F4A7C15 * t) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def block_keys(fp: np.ndarray, plan: Plan) -> np.ndarray:
    """Keys of each fingerprint: one for each choice of ``agree`` blocks."""
    bit, at = np.unpackbits(fp, axis=1).astype(np.int64), 0
    blocks = []
    for w in plan.widths:
        blocks.append(bit[:, at : at + w] @ (1 << np.arange(w - 1, -1, -1, dtype=np.int64)))
        at += w
    keys = []
    for n, choice in enumerate(itertools.combinations(range(len(blocks)), plan.agree)):
        k = np.full(len(fp), n, np.int64)
        for b in choice:
            k = (k << plan.widths[b]) | blocks[b]
        keys.append(k)
    return np.stack(keys, axis=1)


def sampled_bits(plan: Plan, n: int) -> list[np.ndarray]:
    """Bits of each key for ``n`` fingerprints: keys of a width at which unlike fingerprints seldom meet, and so many that a pair of the least
    similarity is missed with chance ``MISSED``. Orders of all bits are drawn and cut, so keys of one order share no bit."""
    width = max(plan.widths[0], math.ceil(math.log2(max(n, 2))) + 1)
    count = math.ceil(math.log(MISSED) / math.log1p(-((1 - _differ(plan.similarity)) ** width)))
    rng, out = np.random.default_rng(SEED), []
    while len(out) < count:
        order = rng.permutation(plan.bits)
        out += [order[a : a + width] for a in range(0, plan.bits - width + 1, width)]
    return out[:count]


def sampled_keys(fp: np.ndarray, chosen: list[np.ndarray]) -> np.ndarray:
    """One key of each fingerprint for each choice of bits."""
    width = len(chosen[0])
    weights = np.zeros((fp.shape[1] * 8, len(chosen)))  # whole numbers below 2**53 are exact
    for n, bits in enumerate(chosen):
        weights[bits, n] = 2.0 ** np.arange(width)
    return (np.unpackbits(fp, axis=1) @ weights).astype(np.int64) + (np.arange(len(chosen), dtype=np.int64) << width)


def with_mates(key: np.ndarray, ident: np.ndarray, distance: int) -> np.ndarray:
    """Which of the rows, sorted by key, share it with a row whose ``PREVIEW`` low bits differ in at most ``distance``; in keys of over ``FEW`` rows all."""
    keep = np.zeros(len(key), bool)
    at, low = np.arange(len(key)), np.uint64((1 << PREVIEW) - 1)
    for shift in range(1, FEW + 1):
        at = at[at + shift < len(key)]
        at = at[key[at] == key[at + shift]]
        if not len(at):
            return keep
        near = at[np.bitwise_count((ident[at] ^ ident[at + shift]) & low) <= distance]
        keep[near] = keep[near + shift] = True
    return keep | np.isin(key, key[at])


def spanning_forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of rows that connect whatever ``near`` (of a row, which of others) connects, at most one fewer than ``n``."""
    left, out = np.arange(n), []
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            i = reached.pop()
            hit = near(i, left)
            out += [(i, x) for x in left[hit].tolist()]
            reached += left[hit].tolist()
            left = left[~hit]
    return out


def common_counts(values: np.ndarray, counts: np.ndarray, columns: int = 4096) -> np.ndarray:
    """How many values each two of the sets share that lie one after the other in ``values``."""
    own = np.repeat(np.arange(len(counts)), counts)
    distinct, at = np.unique(values, return_inverse=True)
    often = np.bincount(at, minlength=len(distinct)) > 1
    at, own = (np.cumsum(often) - 1)[at][keep := often[at]], own[keep]
    order = np.argsort(at, kind="stable")
    at, own = at[order], own[order]
    out = np.zeros((len(counts), len(counts)), np.int64)
    for first in range(0, int(often.sum()), columns):
        some = slice(*np.searchsorted(at, [first, first + columns]))
        has = np.zeros((len(counts), columns), np.float32)
        has[own[some], at[some] - first] = 1
        out += (has @ has.T).astype(np.int64)
    return out


def spanning_links(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Pairs of rows within ``distance`` that connect whatever such pairs connect, at most one fewer than rows.

    Each pivot takes what lies within ``distance`` of it; two such sets can hold a close pair only if their pivots
    lie within three times that, and are compared only while nothing connects them yet.
    """
    v = np.ascontiguousarray(fp).view(np.uint64)
    gap = lambda a, b: np.bitwise_count(v[a] ^ v[b]).sum(-1, dtype=np.int64)
    left, links, pivots, sets = np.arange(len(v)), [], [], []
    while len(left):
        d = gap(left, left[:1])
        near, p = left[d <= distance], int(left[0])
        links += [(p, x) for x in near[1:].tolist()]
        pivots.append(p)
        sets.append(near)
        left = left[d > distance]
    root = list(range(len(pivots)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    order = np.array(pivots)
    for i in range(len(pivots) - 1):
        if len(sets[i]) == 1 and all(len(s) == 1 for s in sets[i + 1 :]):
            break  # lone pivots are further apart than the distance
        for j in (i + 1 + np.flatnonzero(gap(order[i + 1 :], order[i : i + 1]) <= 3 * distance)).tolist():
            if find(i) == find(j):
                continue
            small, large = sorted((sets[i], sets[j]), key=len)
            for x in small.tolist():
                hit = np.flatnonzero(gap(large, np.array([x])) <= distance)
                if len(hit):
                    links.append((x, int(large[hit[0]])))
                    root[find(j)] = find(i)
                    break
    return links


def fingerprint_rows(docs: DataFrame, plan: Plan, text: str = "text", cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``cols`` of each row, with fp."""
    small_batches(docs.sparkSession)
    make = lambda b: {"fp": to_binary(fingerprints(b.column(b.schema.get_field_index("_text")).to_pylist(), plan.words, plan.bits))}
    return add_columns(docs.select(*cols, F.col(text).alias("_text")), make, "fp binary", drop=["_text"])


def _tiled(rows: DataFrame, plan: Plan) -> DataFrame:
    """Rows (key, fp) with the pairs of tiles (a, b) that large keys are dealt as."""
    large = rows.groupBy("key").count().filter(F.col("count") > plan.tile).select("key", F.ceil(F.col("count") / plan.tile).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    rows = rows.join(large, "key", "left").withColumn("t", F.coalesce(tile, F.lit(0)))
    rows = rows.select("key", "fp", "t", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tiles"), F.lit(1)) - 1)).alias("o"))
    return rows.select("key", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"), "fp")


def links(distinct: DataFrame, plan: Plan) -> DataFrame:
    """Links (src, dst) between distinct fingerprints ``fp`` that connect all that lie within the distance."""
    width = plan.bits // 8

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                fp = binary_rows(t, "fp", width)
                k = block_keys(fp, plan)
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), to_binary(np.repeat(fp, k.shape[1], axis=0))], names=["key", "fp"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["key", "a", "b"]):
            starts = group_starts(t, ["key", "a", "b"])
            sizes = np.diff(np.append(starts, t.num_rows))
            fp = binary_rows(t, "fp", width)
            two = starts[sizes == 2]
            v = np.ascontiguousarray(fp).view(np.uint64)
            two = two[np.bitwise_count(v[two] ^ v[two + 1]).sum(1, dtype=np.int64) <= plan.distance]
            src, dst = [two], [two + 1]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                pairs = np.array(spanning_links(fp[s : s + n], plan.distance), np.int64).reshape(-1, 2)
                src.append(pairs[:, 0] + s)
                dst.append(pairs[:, 1] + s)
            src, dst = np.concatenate(src), np.concatenate(dst)
            if len(src):
                yield pa.RecordBatch.from_arrays([to_binary(fp[src]), to_binary(fp[dst])], names=["src", "dst"])

    rows = distinct.mapInArrow(keyed, "key bigint, fp binary")
    return _tiled(rows, plan).repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(verified, "src binary, dst binary")


def more_links(fp: np.ndarray, distance: int, agreed: list[tuple[int, int]], rejected: list[tuple[int, int]], times: int = 1) -> list[tuple[int, int]]:
    """Pairs of rows within ``distance``, none of them rejected, between what the agreed ones leave apart: first so many as connect it, at most one fewer
    than rows; with ``times`` above one the closest, up to so many times the rows."""
    v, part, out = np.ascontiguousarray(fp).view(np.uint64), np.arange(len(fp)), []
    no: dict[int, list[int]] = {}
    for x, y in rejected:
        no.setdefault(min(x, y), []).append(max(x, y))
    for x, y in agreed:
        part[part == part[y]] = part[x]
    far, most = np.empty((3, 0), np.int32), times * len(v)  # gap and rows of the closest pairs so far, and some more
    for i in range(len(v) - 1):
        gap = np.bitwise_count(v[i + 1 :] ^ v[i]).sum(1, dtype=np.int64)
        near = np.flatnonzero((gap <= distance) & (part[i + 1 :] != part[i]))
        near = i + 1 + near[np.argsort(gap[near], kind="stable")]  # the closest are the likeliest to be similar
        near = near[~np.isin(near, no[i])] if i in no else near
        if times > 1:
            far = np.concatenate([far, np.stack([gap[near - i - 1], np.full(len(near), i), near]).astype(np.int32)], axis=1)
            if far.shape[1] > 2 * most:
                far = far[:, np.sort(np.argsort(far[0], kind="stable")[:most])]
            continue
        while len(near := near[part[near] != part[i]]):
            out.append((i, int(near[0])))
            part[part == part[near[0]]] = part[i]
    if times > 1:
        far = far[:, np.argsort(far[0], kind="stable")[:most]]
        out = list(zip(far[1].tolist(), far[2].tolist(), strict=True))
    return out


def similar_links(distinct: DataFrame, sets_of: Callable[[DataFrame], DataFrame], plan: Plan) -> DataFrame:
    """Links (src, dst) between nodes, which are fingerprints and 16 bytes that identify the shingle set: some that connect what all pairs with
    similar sets connect, as far as links of fingerprints join them to one family. ``sets_of`` gives rows (fp, set) of nodes.

    Only a fingerprint's number travels with its keys, with ``PREVIEW`` of its bits; the whole ones join where a key has others like it.
    Each set goes to one task; those of a family of more than ``tile`` sets go to pairs of tiles, unless links between
    its fingerprints hold for the sets too and connect it already.
    """
    bits, width = plan.bits // 8, plan.bits // 8 + 16
    chosen, p = sampled_bits(plan, distinct.count()), _differ(plan.similarity)
    preview = int(PREVIEW * p + 3.5 * math.sqrt(PREVIEW * p * (1 - p)))
    # a number's low bits are the fingerprint's first; should two nodes have the same, each is proposed with the other's mates
    number = F.conv(F.concat(F.hex(F.substring("fp", width - 2, 3)), F.hex(F.substring("fp", 1, PREVIEW // 8))), 16, -10).cast("bigint")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                k = sampled_keys(binary_rows(t, "fp", width)[:, :bits], chosen)
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.repeat(column_np(t, "id"), k.shape[1]))], names=["key", "id"])

    def mated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["key"]):
            keep = with_mates(column_np(t, "key"), column_np(t, "id").view(np.uint64), preview)
            yield from t.filter(pa.array(keep)).to_batches()

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["key", "a", "b"]):
            starts = group_starts(t, ["key", "a", "b"])
            fp, src, dst = binary_rows(t, "fp", width), [], []
            v = np.ascontiguousarray(fp[:, :bits]).view(np.uint64)
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
                pairs = spanning_forest(e - s, lambda i, left: np.bitwise_count(v[s + left] ^ v[s + i]).sum(1, dtype=np.int64) <= plan.distance)  # noqa: B023
                src += [s + x for x, _ in pairs]
                dst += [s + y for _, y in pairs]
            if src:
                yield pa.RecordBatch.from_arrays([to_binary(fp[src]), to_binary(fp[dst])], names=["src", "dst"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["family", "a", "b"]):
            starts = group_starts(t, ["family", "a", "b"])
            fp, src, dst = binary_rows(t, "fp", width), [], []
            sets = t.column("set").combine_chunks()
            sets = pa.concat_arrays(sets.chunks) if isinstance(sets, pa.ChunkedArray) else sets
            at, values = sets.offsets.to_numpy(), sets.values.to_numpy()
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
                if e - s < 2:
                    continue
                counts = np.diff(at[s : e + 1])
                both = common_counts(values[at[s] : at[e]], counts)
                near = both >= plan.similarity * (counts[:, None] + counts - both) - 1e-9
                pairs = spanning_forest(e - s, lambda i, left: near[i, left])  # noqa: B023
                src += [s + x for x, _ in pairs]
                dst += [s + y for _, y in pairs]
            if src:
                yield pa.RecordBatch.from_arrays([to_binary(fp[src]), to_binary(fp[dst])], names=["src", "dst"])

    def compared(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition("family", "a", "b").sortWithinPartitions("family", "a", "b")
        return dealt.mapInArrow(similar, "src binary, dst binary")

    nodes = distinct.select("fp", number.alias("id"))
    keys = nodes.mapInArrow(keyed, "key bigint, id bigint").repartition("key").sortWithinPartitions("key").mapInArrow(mated, "key bigint, id bigint")
    mates = stored(keys, "mates")
    met = stored(mates.join(nodes, "id").select("key", "fp"), "met")
    remove(mates)
    dealt = _tiled(met, plan).repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    proposed = stored(dealt.mapInArrow(close, "src binary, dst binary").distinct(), "proposed")
    remove(met)
    family = stored(components(proposed).select(F.col("node").alias("fp"), F.col("component").alias("family")), "families")
    sets = stored(sets_of(family.select("fp")).join(family, "fp").select("family", "fp", "set"), "sets")
    size = sets.groupBy("family").agg(F.count("*").alias("n"), F.sum(F.size("set")).alias("of"))
    tiles = stored(size.select("family", F.greatest(F.ceil(F.col("n") / plan.tile), F.ceil(F.col("of") / TILE_SHINGLES), F.lit(1)).cast("int").alias("tiles")), "tiles")
    large = tiles.filter("tiles > 1")
    made = stored(compared(sets.join(large, "family", "left_anti").withColumns({"a": F.lit(0), "b": F.lit(0)})), "similar")
    if large.isEmpty():
        remove(sets)
        return made
    # of a large family, what the proposed links and each tile alone connect; then pairs of tiles, if something is left apart
    own = stored(sets.join(large, "family").withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")), "large")
    one, two = own.select(F.col("fp").alias("src"), F.col("set").alias("x")), own.select(F.col("fp").alias("dst"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    agreed = proposed.join(one, "src").join(two, "dst").filter(both >= plan.similarity * (F.size("x") + F.size("y") - both) - 1e-9).select("src", "dst")
    first = stored(agreed.union(compared(own.withColumns({"a": F.col("t"), "b": F.col("t")}))), "agreed")
    part = own.select("family", "fp").join(components(first).withColumnRenamed("node", "fp"), "fp", "left").groupBy("family").agg(F.countDistinct(F.coalesce("component", "fp")).alias("parts"))
    going = own.join(part.filter("parts > 1"), "family", "left_semi")
    going = going.select("family", "fp", "set", "t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o")).filter("t <> o")
    rest = compared(going.select("family", "fp", "set", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b")))
    return made.union(first).union(stored(rest, "rest"))


def fingerprint_classes(prints: DataFrame, plan: Plan, ident: str = "doc_id", sets_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(fp, smallest): for each distinct fingerprint the smallest ``ident`` of its component; links are verified with ``sets_of`` if given."""
    nodes = stored(prints.groupBy("fp").agg(F.min(ident).alias("own")), "fingerprints")
    made = similar_links(nodes.select("fp"), lambda some: sets_of(nodes.join(some, "fp")), plan) if sets_of else links(nodes.select("fp"), plan)
    found = components(made).withColumnRenamed("node", "fp")
    linked = stored(nodes.join(found, "fp"), "linked")
    least = linked.groupBy("component").agg(F.min("own").alias("smallest"))
    alone = nodes.join(found.select("fp"), "fp", "left_anti").select("fp", F.col("own").alias("smallest"))
    return linked.join(least, "component").select("fp", "smallest").union(alone)


def near_duplicates(docs: DataFrame, plan: Plan = Plan(), text: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (hex), component_id (smallest doc_id reachable over links)."""
    prints = stored(fingerprint_rows(docs, plan, text), "prints")
    return prints.join(fingerprint_classes(prints, plan), "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("smallest").alias("component_id"))


def keep_one(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest doc_id (nulls last), then text. All columns stay as they are."""
    plan = plan or Plan.by_similarity()
    ident = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), text_key(F.col("text")).alias("k"))
    small_batches(docs.sparkSession)

    def node(b: pa.RecordBatch) -> dict[str, pa.Array]:
        sets = [np.unique(shingles(t, plan.words)) for t in b.column(b.schema.get_field_index("_text")).to_pylist()]
        digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(h.tobytes()) for h in sets), np.uint8).reshape(-1, 16)
        return {"fp": to_binary(np.concatenate([fingerprints(sets, plan.words, plan.bits), digest], axis=1))}

    def shingle_set(b: pa.RecordBatch) -> dict[str, pa.Array]:
        sets = [np.unique(shingles(t, plan.words)).view(np.int64) for t in b.column(b.schema.get_field_index("_text")).to_pylist()]
        return {"set": list_array(np.concatenate(sets), map(len, sets), pa.int64())}

    def sets_of(nodes: DataFrame) -> DataFrame:
        own = nodes.select("fp", F.col("own.k").alias("_k"))
        texts = docs.select(text_key(F.col("text")).alias("_k"), F.col("text").alias("_text")).join(own.select("_k"), "_k", "left_semi").dropDuplicates(["_k"])
        return add_columns(texts.join(own, "_k").select("fp", "_text"), shingle_set, "set array<bigint>", drop=["_text"])

    prints = add_columns(docs.select(ident.alias("_i"), F.col("text").alias("_text")), node, "fp binary", drop=["_text"])
    prints = stored(prints.distinct(), "prints")
    kept = fingerprint_classes(prints, plan, "_i", sets_of).select("smallest").distinct()
    n, d, k, row = key = free_names(docs, "n", "d", "k", "row")
    kept = kept.select(F.col("smallest.n").alias(n), F.coalesce("smallest.d", F.lit(0)).alias(d), F.col("smallest.k").alias(k))
    rows = docs.withColumns({n: F.col("doc_id").isNull(), d: F.coalesce("doc_id", F.lit(0)), k: text_key(F.col("text"))})
    one = rows.join(kept, key[:3], "left_semi").groupBy(*key[:3]).agg(F.min(F.struct(*docs.columns)).alias(row))  # rows can repeat doc_id and text
    return one.select(f"{row}.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: three words, 64 bits, three differing bits."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
