"""Approximate nearest neighbours by shifted space-filling curves (operator 4).

Each of several curves projects vectors at random onto a few axes, shifts them, and orders them along a Hilbert curve, whose cells are so small that near
copies are told apart. Its order is cut into ranges of about a fixed number of rows, at keys of a sample. A query asks at several places of each
curve (probes): its own key, and the keys of shifted copies of its projection; it goes once to each range in which a probe lies. At each, the candidates
are the rows in a window of neighbouring keys, of a fixed size; rows near a range's ends meet those of the next range in a second step. Vectors travel as they are, so
a range's list of best numbers is settled in double precision; a query's lists merge, and what is left is scored again as the contract says.

Ranges hold a fixed number of rows and tasks grow with the table: each query scores at most curves x probes x (2 x window)
rows of a band. Recall is good where vectors have structure, as most models give. Vectors without any
(independent components) have no near region that an index could single out: there more ``probes`` with a wider ``spread`` help, at the
price of scoring a share of the table that is no less than the recall allows. ``search_to`` measures the recall on a sample of queries,
asks at twice as many places and in windows twice as wide until it suffices.

Equal vectors share every score, so each distinct vector is one point, with the ``k + 1`` smallest ids among its rows: no
other row of it can be among the best. A vector that very many rows hold is thus no large group; rows are ranked within
the map tasks before they are shuffled. Queries ask once for each distinct vector.

Inner products of vectors of unequal length are turned into distances by one more axis, as is usual for this measure: for
rows it holds what is missing to the longest vector's square, for queries, whose length does not matter, nothing. Where few vectors are much longer than the others, this
would put all others in one place; so lengths within a factor of two, around a power of two, are a band with curves of its own, and neighbouring bands that
one window covers together are one.

Null vectors, zero vectors and vectors with null or non-finite components take no part; nor do rows with a null id
or vectors of another length than most. Rows that repeat an id and vector count once. Rows of one id with different vectors are
rows of their own: each asks, and none is a candidate for another. No rows give an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary_rows, column_np, group_starts, list_array, remove, stored, to_binary, whole_groups

#: Curves, axes of each, bits of a key on each axis (near copies need many); rows of a window on either side, places at which a query asks on each curve, and how far
#: the shifted ones lie from its own (0: there, 1: anywhere).
CURVES, AXES, BITS, WINDOW, PROBES, SPREAD = 5, 10, 24, 200, 6, 0.1
#: Rows of a range, about, and keys a range that are sampled to find its ends; candidates beyond k that a list keeps, as rounding changes the order of near ones.
RANGE, SAMPLED, MARGIN = 20_000, 20, 10


def usable(vector: Column) -> Column:
    """Whether a vector takes part: neither null nor zero, all components finite."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def transposed(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of rows of integer cells as Skilling's transposed index: a row for each axis."""
    x, n = cells.astype(np.int64).T.copy(), cells.shape[1]
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess work of each level
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    return x ^ t


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of rows of integer cells (fewer than 64 bits together)."""
    x, key = transposed(cells, bits), np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | ((axis >> b) & 1)
    return key


def key_bytes(cells: np.ndarray, bits: int, n: np.ndarray) -> np.ndarray:
    """Positions of any length as rows of bytes in order, with the row's number at their end: no two rows share a key."""
    x = transposed(cells, bits)
    levels = np.stack([((x >> b) & 1).astype(np.uint8).T for b in range(bits - 1, -1, -1)], axis=1)
    return np.hstack([np.packbits(levels.reshape(len(cells), -1), axis=1), n.astype(">i8").view(np.uint8).reshape(-1, 8)])


def projections(v: np.ndarray, curve: int, longest: float, asks: bool, axes: int = AXES) -> np.ndarray:
    """Places of vectors (rows of doubles, none longer than ``longest``) on one curve's axes; those of rows that don't tell their
    direction have a deviation of 1/6 on each axis."""
    rng = np.random.default_rng(1000 + curve)
    if asks:
        v = v / np.abs(v).max(1, keepdims=True)  # else squares of very long or short ones have no double
        v = np.hstack([v / np.sqrt((v * v).sum(1, keepdims=True)), np.zeros((len(v), 1))])
    else:
        v = v / longest
        v = np.hstack([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(1)))[:, None]])
    basis = np.linalg.qr(rng.standard_normal((v.shape[1], min(axes, v.shape[1]))))[0]
    return v @ basis * np.sqrt(v.shape[1] - 1) / 6


def keys_of(places: np.ndarray, curve: int, n: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys of places, shifted by the curve's own shift; nearly all lie within (-0.75, 1) then."""
    shift = np.random.default_rng(5000 + curve).uniform(0, 0.25, places.shape[1])
    return key_bytes(np.clip((places + shift + 1) * (1 << (bits - 1)), 0, (1 << bits) - 1).astype(np.int64), bits, n)


def probe_keys(v: np.ndarray, curve: int, n: np.ndarray, probes: int, spread: float) -> np.ndarray:
    """For each query the keys at which it asks on a curve, its own first: its place moved towards a random one."""
    own = projections(v, curve, 1.0, True)
    noise = np.random.default_rng(9000 + curve).standard_normal((probes, own.shape[1])) / 6
    stay = 1 - spread
    return np.stack([keys_of(own if j == 0 else stay * own + np.sqrt(1 - stay * stay) * noise[j], curve, n) for j in range(probes)], axis=1)


def ordered(keys: np.ndarray) -> np.ndarray:
    """Rows of bytes as strings that numpy compares."""
    return np.ascontiguousarray(keys).view(f"S{keys.shape[-1]}")[..., 0]


def bands(octaves: list[tuple[int, int, float]], window: int) -> list[tuple[int, int, float]]:
    """Of octaves of the length (least, rows, longest), longest first, the bands: neighbours whose rows one window covers are one. Shortest first."""
    out: list[tuple[int, int, float]] = []
    for low, rows, longest in octaves:
        if out and out[-1][1] + rows <= window:
            out[-1] = (low, out[-1][1] + rows, out[-1][2])
        else:
            out.append((low, rows, longest))
    return out[::-1]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the ``k`` largest scores, ties to smaller ids."""
    if scores.dtype == object:  # Python's integers
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def window_lists(data: np.ndarray, ids: np.ndarray, codes: np.ndarray, at: np.ndarray, asks: np.ndarray, window: int, keep: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query among ``asks`` (its number, once for each probe; ``at``: data rows before the probe; ``codes``: its code): its number, and ids
    and scores of the best ``keep`` in the union of its windows."""
    order = np.argsort(asks, kind="stable")
    starts = np.flatnonzero(np.append(True, asks[order][1:] != asks[order][:-1])) if len(order) else np.empty(0, np.int64)
    for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=False):
        own = order[a:z]
        inside = np.zeros(len(ids) + 1, np.int32)
        np.add.at(inside, np.maximum(at[own] - window, 0), 1)
        np.add.at(inside, np.minimum(at[own] + window, len(ids)), -1)
        rows = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        if len(rows):
            score = data[rows] @ codes[own[0]]
            top = best(score, ids[rows], keep)
            yield int(asks[own[0]]), ids[rows[top]], score[top]


def search(vectors: DataFrame, every: int = 20, k: int = 20, ident: str = "vec_id", vector: str = "embedding", curves: int = CURVES, window: int = WINDOW, probes: int = PROBES, spread: float = SPREAD, range_rows: int = RANGE) -> DataFrame:
    """Per query (a row whose id is divisible by ``every``) its ``k`` nearest other rows found: query_id, rank, vec_id, score."""
    zero = F.lit(0.0).cast("float" if dict(vectors.dtypes)[vector] == "array<float>" else "double")  # makes -0.0 equal to 0.0
    rows = vectors.filter(usable(F.col(vector))).select(F.col(ident).cast("bigint").alias("id"), F.transform(vector, lambda x: x + zero).alias("v")).filter("id is not null")
    rows = rows.select("id", F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit(1)).alias("h2"), "v")
    point = ["h1", "h2"]
    best_rows = rows.dropDuplicates(["id", *point]).withColumn("r", F.row_number().over(Window.partitionBy(*point).orderBy("id"))).filter(F.col("r") <= k + 1)
    points = best_rows.groupBy(*point).agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))
    asked = rows.filter(F.col("id") % every == 0).select("id", *point).distinct()
    points = points.join(asked.select(*point).distinct().withColumn("q", F.lit(True)), point, "left").withColumn("n", F.monotonically_increasing_id())
    most = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    length = most * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("most")) * (x / F.col("most"))))
    points = points.withColumn("most", most).withColumn("length", length).withColumn("octave", F.floor(F.log2("length") + 0.5).cast("int"))
    points = stored(points.select("n", *point, "v", "ids", F.coalesce("q", F.lit(False)).alias("q"), "length", "octave"), "points")
    dim = points.agg(F.mode(F.size("v"))).first()[0] or 0
    points, keep, range_rows = points.filter(F.size("v") == dim), k + MARGIN, max(range_rows, 4 * window)
    own = bands([tuple(x) for x in points.groupBy("octave").agg(F.count("*"), F.max("length")).orderBy(F.desc("octave")).collect()], window)
    lows = np.array([low for low, _, _ in own])
    # a band that a window covers needs one curve and one probe
    lanes = [(b, c, longest, probes if rows > window else 1, -(-rows // range_rows)) for b, (_, rows, longest) in enumerate(own) for c in range(curves if rows > window else 1)]
    kind = np.float32 if dict(points.dtypes)["v"] == "array<float>" else np.float64
    wide = -(-min(AXES, dim + 1) * BITS // 8) + 8

    def read(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, vectors and bands of points."""
        v = np.asarray(b.column(1).flatten()).astype(kind, copy=False).reshape(b.num_rows, dim)
        return b.column(0).to_numpy(), v, np.searchsorted(lows, b.column(2).to_numpy(), "right") - 1

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, v, band = read(b)
            for lane, (own_band, c, longest, _, ranges_) in enumerate(lanes):
                at = np.flatnonzero(band == own_band)
                if ranges_ > 1 and len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lane)), to_binary(keys_of(projections(v[at].astype(np.float64), c, longest, False), c, n[at]))], names=["lane", "key"])

    ends = [np.empty(0, f"S{wide}") for _ in lanes]  # keys at which ranges of a lane begin, but for the first
    if any(x[-1] > 1 for x in lanes):
        some: dict[int, list[bytes]] = {}
        for r in points.filter(F.pmod(F.xxhash64("n"), F.lit(range_rows)) < SAMPLED).select("n", "v", "octave").mapInArrow(sampled, "lane bigint, key binary").toLocalIterator():
            some.setdefault(r.lane, []).append(bytes(r.key))
        for lane, found in some.items():
            cuts = lanes[lane][-1]
            found = np.array(sorted(found), f"S{wide}")
            ends[lane] = np.unique(found[(np.arange(1, cuts) * len(found)) // cuts])
    starts = np.cumsum([0, *(len(x) + 1 for x in ends)])  # the number of each lane's first range

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of each point in its range on each curve of its band, and one of each query for each range in which it asks, with the keys of its probes there."""
        for b in batches:
            if not b.num_rows:
                continue
            n, v, band = read(b)
            asks = np.flatnonzero(b.column(3).to_numpy(zero_copy_only=False))
            for lane, (own_band, c, longest, places, _) in enumerate(lanes):
                at = np.flatnonzero(band == own_band)
                if len(at):
                    key = keys_of(projections(v[at].astype(np.float64), c, longest, False), c, n[at])
                    at_range = starts[lane] + np.searchsorted(ends[lane], ordered(key), "right")
                    yield pa.RecordBatch.from_arrays([pa.array(at_range), pa.array(np.zeros(len(at), bool)), to_binary(key), pa.array(n[at]), to_binary(v[at].view(np.uint8))], names=names[:5])
                if len(asks):
                    key = probe_keys(v[asks].astype(np.float64), c, n[asks], places, spread).reshape(-1, wide)
                    yield asking(starts[lane] + np.searchsorted(ends[lane], ordered(key), "right"), np.repeat(asks, places), key, n, v)

    def asking(group: np.ndarray, row: np.ndarray, key: np.ndarray, n: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        """Probes (the query's row, the key), gathered by group and query."""
        order = np.lexsort((row, group))
        group, row, key = group[order], row[order], np.ascontiguousarray(key[order])
        first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (row[1:] != row[:-1])))
        off = (np.append(first, len(row)) * wide).astype(np.int32)
        keys = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(off), pa.py_buffer(key)])
        return pa.RecordBatch.from_arrays([pa.array(group[first].astype(np.int64)), pa.array(np.ones(len(first), bool)), keys, pa.array(n[row[first]]), to_binary(v[row[first]].view(np.uint8))], names=names[:5])

    names = ["grp", "ask", "key", "n", "v", "ids", "scores"]
    keyed_schema = "grp bigint, ask boolean, key binary, n bigint, v binary"
    schema = f"{keyed_schema}, ids array<bigint>, scores array<double>"

    def with_lists(b: pa.RecordBatch, found: list[tuple[int, np.ndarray, np.ndarray]] | None = None) -> pa.RecordBatch:
        """Rows for the borders, or lists of queries, in the columns of both."""
        if found is None:
            return pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.list_(pa.int64())), pa.nulls(b.num_rows, pa.list_(pa.float64()))], names=names)
        size = len(found)
        return pa.RecordBatch.from_arrays([
            pa.nulls(size, pa.int64()), pa.nulls(size, pa.bool_()), pa.nulls(size, pa.binary()), pa.array([x for x, _, _ in found], pa.int64()), pa.nulls(size, pa.binary()),
            list_array(np.concatenate([x for _, x, _ in found]), [len(x) for _, x, _ in found], pa.int64()), list_array(np.concatenate([x for *_, x in found]), [len(x) for *_, x in found], pa.float64()),
        ], names=names)

    def answered(batches: Iterator[pa.RecordBatch], borders: bool) -> Iterator[pa.RecordBatch]:
        """Lists of queries in the rows of each group, which come first and in order; queries are read as they come. With ``borders`` also the rows near a range's ends
        and the probes whose windows reach over them, for the borders with its neighbours."""
        group, held, keys, ids, data = None, [], None, None, None

        def gathered() -> None:
            nonlocal keys, ids, data
            t = pa.Table.from_batches(held, schema=held[0].schema) if held else None
            keys = ordered(binary_rows(t, "key", wide)) if held else np.empty(0, f"S{wide}")
            ids = column_np(t, "n") if held else np.empty(0, np.int64)
            data = np.ascontiguousarray(binary_rows(t, "v", dim * kind().itemsize)).view(kind).astype(np.float64) if held else np.empty((0, dim))

        def sides(g: int) -> list[tuple[int, bool]]:
            """Borders of a range: their numbers, and whether they are its lower ends."""
            lane = int(np.searchsorted(starts, g, "right")) - 1
            return [(x, low) for x, low in ((g, True), (g + 1, False)) if starts[lane] < x < starts[lane + 1]] if borders else []

        def edges() -> Iterator[pa.RecordBatch]:
            if group is None or not (own_sides := sides(group)):
                return
            t = pa.Table.from_batches(held) if held else None
            for x, low in own_sides if t is not None else []:
                for b in (t.slice(0, window) if low else t.slice(max(0, t.num_rows - window))).to_batches():
                    yield with_lists(pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, x)), *b.columns[1:5]], names=names[:5]))

        for b in batches:
            cut = group_starts(pa.Table.from_batches([b]), ["grp", "ask"]).tolist()
            for a, z in zip(cut, [*cut[1:], b.num_rows], strict=True):
                piece = b.slice(a, z - a)
                if (g := piece.column(0)[0].as_py()) != group:
                    yield from edges()
                    group, held, data = g, [], None
                if not piece.column(1)[0].as_py():
                    held.append(piece.select(names[:5]))
                    continue
                if data is None:
                    gathered()
                for at in range(0, piece.num_rows, 256):
                    t = pa.Table.from_batches([piece.slice(at, 256)])
                    sizes = np.array([len(x) // wide for x in t.column("key").to_pylist()])
                    probe = np.frombuffer(b"".join(t.column("key").to_pylist()), np.uint8).reshape(-1, wide)
                    v = np.ascontiguousarray(binary_rows(t, "v", dim * kind().itemsize)).view(kind)
                    row, place, n = np.repeat(np.arange(t.num_rows), sizes), np.searchsorted(keys, ordered(probe)), column_np(t, "n")
                    if found := list(window_lists(data, ids, v[row].astype(np.float64), place, n[row], window, keep)):
                        yield with_lists(None, found)
                    for x, low in sides(g):
                        over = np.flatnonzero(place < window if low else place > len(ids) - window)
                        if len(over):
                            yield with_lists(asking(np.full(len(over), x), row[over], probe[over], n, v))
        yield from edges()

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from answered(batches, True)

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from answered(batches, False)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of all lists of a query (bounded by curves and probes) the best numbers."""
        for t in whole_groups(batches, ["n"]):
            t = t.combine_chunks()
            n, ids, off = column_np(t, "n"), column_np(t, "ids"), np.flatnonzero(np.append(np.diff(column_np(t, "n")) != 0, True)) + 1
            out, size, a = [], [], 0
            scores = column_np(t, "scores")
            for z in off.tolist():
                x, first = np.unique(np.concatenate(ids[a:z]), return_index=True)
                out.append(x[best(np.concatenate(scores[a:z])[first], x, keep)])
                size.append(len(out[-1]))
                a = z
            yield pa.RecordBatch.from_arrays([pa.array(n[off - 1]), list_array(np.concatenate(out), size, pa.int64())], names=["q", "ids"])

    dealt = points.select("n", "v", "octave", "q").mapInArrow(keyed, keyed_schema)
    order = ["grp", "ask", "key", "n"]
    steps = stored(dealt.repartition(max(1, int(starts[-1])), "grp").sortWithinPartitions(*order).mapInArrow(ranges, schema), "ranges")
    found = steps.filter("grp is null")
    if len(starts) and starts[-1] > len(lanes):
        found = found.union(steps.filter("grp is not null").select(*names[:5]).repartition("grp").sortWithinPartitions(*order).mapInArrow(borders, schema))
    found = found.select("n", "ids", "scores").repartition("n").sortWithinPartitions("n").mapInArrow(merged, "q bigint, ids array<bigint>")
    pairs = stored(found.select("q", F.explode("ids").alias("n")), "pairs")
    remove(steps)
    other = points.filter("q").select(F.col("n").alias("q"), F.col("v").alias("w"), *point)
    score = F.aggregate(F.zip_with("v", "w", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    scored = pairs.join(points.select("n", "v", "ids"), "n").join(other, "q").select(*point, score.alias("score"), F.explode("ids").alias("vec_id"))
    ranked = scored.withColumn("r", F.row_number().over(Window.partitionBy(*point).orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1)
    ranked = ranked.groupBy(*point).agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    out = asked.join(ranked, point).select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("found", lambda x: x.vec_id != F.col("id")), 1, k)).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def exact_sample(vectors: DataFrame, every: int, k: int, sample: int, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The true ``k`` nearest (query_id, vec_id) of ``sample`` queries, those of the smallest hashes, by one pass over all rows; the sample's vectors travel to the tasks."""
    rows = vectors.filter(usable(F.col(vector))).select(F.col(ident).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null")
    dim = rows.agg(F.mode(F.size("v"))).first()[0] or 0
    rows = rows.filter(F.size("v") == dim)
    asked = rows.filter(F.col("id") % every == 0).orderBy(F.xxhash64("id"), "v").limit(sample).collect()
    one = list({r.id: r.v for r in asked}.items())
    ids, q = np.array([i for i, _ in one], np.int64), np.array([v for _, v in one]).reshape(len(one), dim)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, near = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
        for b in batches:
            n = b.column(0).to_numpy()
            if not len(n) or not len(q):
                continue
            scores = q @ np.asarray(b.column(1).flatten(), np.float64).reshape(len(n), dim).T
            scores[ids[:, None] == n[None, :]] = -np.inf
            scores, all_ids = np.hstack([top, scores]), np.hstack([near, np.broadcast_to(n, (len(q), len(n)))])
            at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            top, near = np.take_along_axis(scores, at, 1), np.take_along_axis(all_ids, at, 1)
        at = np.flatnonzero(top.ravel() > -np.inf)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)[at]), pa.array(near.ravel()[at]), pa.array(top.ravel()[at])], names=["query_id", "vec_id", "score"])

    found = rows.mapInArrow(nearest, "query_id bigint, vec_id bigint, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("r") <= k).select("query_id", "vec_id")


def search_to(vectors: DataFrame, recall: float = 0.92, sample: int = 128, every: int = 20, k: int = 20, probes: int = PROBES, **how) -> tuple[DataFrame, float, int]:
    """``search`` with as many probes as the table needs: their number and the rows of a window are doubled until the recall of ``sample`` queries, held against their true
    nearest, is ``recall`` or more. Gives the rows (stored), that recall and the number of probes.

    The sample and its answers have a size of their own; the rest of the work is that of the last search and less than as much again for those before it. Without
    queries the first search stands. It ends at the latest when a window holds the whole table.
    """
    names = {x: how[x] for x in ("ident", "vector") if x in how}
    true = stored(exact_sample(vectors, every, k, sample, **names), "true")
    wanted, most, window = true.count(), vectors.count(), how.pop("window", WINDOW)
    while True:
        found = stored(search(vectors, every, k, probes=probes, window=window, **how), "found")
        got = found.select("query_id", "vec_id").join(true, ["query_id", "vec_id"], "left_semi").distinct().count() / wanted if wanted else 1.0
        if got >= recall or window >= most:
            return found, got, probes
        remove(found)
        probes, window = 2 * probes, 2 * window


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every twentieth row asks for its 20 nearest. The table's vectors have independent components, so queries ask at many places, and at more in larger tables."""
    return search_to(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), curves=8, probes=32, spread=0.25)[0]
