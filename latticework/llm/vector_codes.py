"""Vector code compression: codebooks by exact integer k-means with norm-of-sum bounds (operator 11).

A vector's components become integers floor(scale * x); it is cut into parts, each position with a codebook of its own. Every round
assigns each part to its codebook's nearest entry (squared Euclidean distance, ties to the lower index) and moves
each entry to its parts' componentwise floor(sum / count); unused entries stay. At last parts are assigned again.

Each part keeps two bounds from when its distances were last seen: its distance to its own entry and to the nearest
other one, each with the stamp of that round. The driver retains the codebooks of all rounds. A bound is carried to the
present by the entries' true net displacement since its stamp, the norm of the sum of their moves, which is no larger than the sum of the
norms. Where the own entry is surely nearer than all others the part stays with it unseen. Else the own distance is taken anew (a new
stamp for that bound alone), and only if that doesn't settle it all entries are scanned again. Bounds leave more than the rounding of
doubles between them, and equal distances are never settled by bounds, so the result is that of scanning all.

A round is one pass over a table in the shared folder: rows with their bounds are read and written with new ones by the same
tasks, without a shuffle. A task sums what its changed parts add to and take from the entries; these few rows (entries x components
a task) are stored in the same table, so a task that runs again counts once, and Spark sums them exactly. The driver holds only codebooks.

Rows whose vector is null or has a null or non-finite component are dropped; so are those of another length than most (of equally frequent
lengths the smallest stays), which no codebook fits. A length that the parts don't divide is an error. The first entries are the vectors of the smallest
distinct ids (of an id's rows the smallest vector; null ids are none of them); with fewer ids there are fewer entries, with none the
first rows' vectors in ascending order serve. Rows that repeat count each. Other columns stay as they are; without rows the result is empty. Integers are exact at
any size: where 64 bits could overflow, Python's integers are used, which is slow; an error that is no 64-bit integer fails.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_rows, free_names, remove, stored, to_binary
from .topk import finite, scaled

#: What a part keeps: its entry, the bounds' stamps (255: none yet), its distance to that entry and to the nearest other.
STATE = np.dtype([("entry", "u1"), ("own_round", "u1"), ("other_round", "u1"), ("own", "<f8"), ("other", "<f8")])
NEVER, SLACK = 255, 1e-9
SUMS = "slot int, amount decimal(38,0)"


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(-1)


def root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def assign(x: np.ndarray, state: np.ndarray, history: list[np.ndarray], position: int) -> int:
    """Bring one position's ``state`` up to the last of its codebooks for parts ``x`` (rows x width); gives the number of parts scanned against all entries.

    ``history``: codebooks (positions x entries x width) by round.
    """
    now = len(history) - 1
    book = history[now][position]
    net = np.stack([root(squared(book, h[position])) for h in history])  # by stamp and entry: the norm of the sum of moves
    stamps, entries = np.arange(now + 1)[:, None], np.arange(len(book))
    farthest = np.stack([np.where(entries == e, 0.0, net).max(1) for e in entries], axis=1)  # the most that any other entry moved
    seen = state["other_round"] != NEVER
    at = np.flatnonzero(seen)
    scan = np.flatnonzero(~seen)
    assert stamps.size < NEVER

    def unsure(i: np.ndarray) -> np.ndarray:
        s = state[i]
        own_moved, other_moved = net[s["own_round"], s["entry"]], farthest[s["other_round"], s["entry"]]
        slack = SLACK * (1 + s["own"] + own_moved + s["other"] + other_moved)
        return ~(s["own"] + own_moved + slack < s["other"] - other_moved)

    if len(at):
        at = at[unsure(at)]
        own = root(squared(x[at], book[state["entry"][at]]))
        state["own"][at], state["own_round"][at] = own, now
        scan = np.concatenate([scan, at[unsure(at)]])
    for lo in range(0, len(scan), 4096):
        i = scan[lo : lo + 4096]
        d = np.stack([squared(x[i], e) for e in book], axis=1)
        best = d.argmin(1)  # the first of equal ones
        rows = np.arange(len(i))
        own = d[rows, best]
        far = root(d)
        far[rows, best] = np.inf
        state["entry"][i], state["own"][i], state["other"][i] = best, root(own), far.min(1) if len(book) > 1 else 1e300
        state["own_round"][i] = state["other_round"][i] = now
    return len(scan)


def _matrix(column: pa.Array, n: int, exact: str) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return v.astype(np.int64) if exact == "int64" else np.array([[int(y) for y in row] for row in v.tolist()], object).reshape(v.shape)


def _states(column: pa.Array, n: int, parts: int) -> np.ndarray:
    if column.null_count:
        s = np.zeros((n, parts), STATE)
        s["other_round"] = s["own_round"] = NEVER
        return s
    return binary_rows(pa.table({"s": pa.chunked_array([column])}), "s", parts * STATE.itemsize).copy().view(STATE).reshape(n, parts)


def _round(rows: DataFrame, history: list[np.ndarray], exact: str, names: list[str], last: bool) -> DataFrame:
    """One assignment of all rows: the rows with new states (``last``: with code and error), and each task's changes of the entries' sums."""
    vector, state, slot, amount = names
    parts, entries, width = history[0].shape
    plain = [f for f in rows.schema.fields if f.name not in (slot, amount, *([vector, state] if last else []))]
    out = T.StructType(plain + (T._parse_datatype_string(f"`{vector}` binary, `{state}` bigint").fields if last else []) + T._parse_datatype_string(f"`{slot}` int, `{amount}` decimal(38,0)").fields)
    kinds = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal kinds
        zero = np.int64(0) if exact == "int64" else 0
        total = np.zeros((parts, entries, width + 1), object)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            kinds = b.schema
            x = _matrix(b.column(kinds.get_field_index(vector)), n, exact).reshape(n, parts, width)
            s = _states(b.column(kinds.get_field_index(state)), n, parts)
            before, fresh = s["entry"].copy(), s["other_round"] == NEVER
            for p in range(parts):
                assign(x[:, p], s[:, p], history, p)
                moved = np.flatnonzero(fresh[:, p] | (before[:, p] != s["entry"][:, p]))
                for e, sign, of in [*((e, 1, s["entry"]) for e in range(entries)), *((e, -1, before) for e in range(entries))]:
                    i = moved[of[moved, p] == e]
                    i = i if sign > 0 else i[~fresh[i, p]]
                    if len(i):
                        total[p, e, :width] += sign * x[i, p].sum(0, initial=zero).astype(object)
                        total[p, e, width] += sign * len(i)
            made = {}
            if last:
                book = history[-1]
                error = sum(squared(x[:, p], book[p][s["entry"][:, p]]) for p in range(parts))
                made = {vector: to_binary(s["entry"]), state: pa.array(error.tolist(), pa.int64())}
            else:
                made = {state: to_binary(np.ascontiguousarray(s).view(np.uint8).reshape(n, -1))}
            made |= {slot: pa.nulls(n, pa.int32()), amount: pa.nulls(n, pa.decimal128(38, 0))}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else b.column(kinds.get_field_index(f.name)) for f in out.fields], names=out.names)
        if kinds is not None and not last:
            flat = total.reshape(-1)
            at = np.flatnonzero(flat != 0)
            made = {slot: pa.array(at.astype(np.int32)), amount: pa.array([Decimal(int(y)) for y in flat[at]], pa.decimal128(38, 0))}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.nulls(len(at), kinds.field(f.name).type) for f in out.fields], names=out.names)

    return rows.mapInArrow(run, out)


def _smallest(rows: DataFrame, ident: str, whole: str, most: int) -> list[list]:
    """Vectors of the ``most`` smallest distinct ids, of each the smallest; a few rows come from each task, and ids that repeat cost further passes."""
    found: dict = {}
    rows = rows.filter(F.col(ident).isNotNull()).select(ident, whole)
    while True:
        after = rows.filter(F.col(ident) > max(found)) if found else rows
        got = after.orderBy(ident, whole).limit(most).collect()
        for r in got:
            if len(found) < most:
                found.setdefault(r[ident], r[whole])
        if len(found) == most or len(got) < most:
            return [found[i] for i in sorted(found)]


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, ident: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``vectors`` that take part, with columns code (an entry's index, one byte for each part) and error (squared distances summed) in place of
    ``vector``, and the codebooks (parts x entries x width)."""
    if not (0 < entries < 256 and 0 <= rounds < NEVER):
        raise ValueError("entries fit a byte, and so do rounds")
    whole, state, slot, amount = names = free_names(vectors, "integers", "bounds", "slot", "amount")
    kept = vectors.filter(finite(F.col(vector)))
    sizes = kept.groupBy(F.size(vector).alias("n")).agg(F.count("*").alias("rows"), F.max(F.array_max(F.transform(vector, lambda x: F.abs(scaled(x, scale))))).alias("most")).orderBy(F.desc("rows"), "n").limit(1).collect()
    dim, most, n_rows = (sizes[0].n, int(sizes[0].most or 0), sizes[0].rows) if sizes else (parts, 0, 0)
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    exact = "int64" if (2 * most) ** 2 * dim < 2**62 and most * 2**20 < 2**62 else "any"
    integers = F.transform(vector, lambda x: scaled(x, scale))
    if most < 2**31:
        integers = integers.cast("array<int>")
    other = [c for c in vectors.columns if c != vector]
    none = [F.lit(None).cast(kind).alias(c) for c, kind in ((state, "binary"), (slot, "int"), (amount, "decimal(38,0)"))]
    rows = stored(kept.filter(F.size(vector) == dim).select(*other, integers.alias(whole), *none), "integers")
    first = _smallest(rows, ident, whole, entries) or [r[0] for r in rows.select(whole).orderBy(whole).limit(entries).collect()]
    kind = np.int64 if exact == "int64" else object
    book = np.array([[int(y) for y in v] for v in first], kind).reshape(len(first), parts, dim // parts).transpose(1, 0, 2).copy()
    if not first:
        book = np.zeros((parts, 1, dim // parts), kind)
    sums = np.zeros((parts, book.shape[1], dim // parts + 1), object)
    history = [book]
    for _ in range(rounds if n_rows else 0):
        after = stored(_round(rows, history, exact, names, False), "assigned")
        remove(rows)
        flat = sums.reshape(-1)
        for r in after.filter(F.col(slot).isNotNull()).groupBy(slot).agg(F.sum(amount).alias(amount)).collect():  # no more rows than numbers in the codebooks
            flat[r[slot]] += int(r[amount])
        rows, book, counts = after.filter(F.col(slot).isNull()), history[-1].copy(), sums[:, :, -1]
        for p, e in zip(*np.nonzero(counts), strict=True):
            book[p, e] = [int(y) // int(counts[p, e]) for y in sums[p, e, :-1]]
        history.append(book)
    done = _round(rows, history, exact, names, True)
    code, error = free_names(vectors.drop(vector), "code", "error")
    return done.select(*other, F.col(whole).alias(code), F.col(state).alias(error)), history[-1]


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.reshape(-1)).encode()).hexdigest()


def coded(vectors: DataFrame, ident: str = "vec_id", label: str = "label", **how) -> DataFrame:
    """Per row that takes part: id, code in hex, error, the error summed over its label (nulls together), the codebooks' digest."""
    slim = vectors.select(F.col(ident).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.col(how.pop("vector", "embedding")).alias("embedding"))
    last, books = compress(slim, **how)
    digest, rows = books_sha256(books), stored(last, "coded")
    remove(last)
    sums = stored(rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("bigint").alias("label_error")).withColumnRenamed("label", "of"), "label_errors")
    rows = rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every vector's code of 8 parts by 16 entries after 6 rounds."""
    return coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """All distances in every round."""
    nearest = """a{r} as materialized (select row_id, part, arg_min(entry, (d, entry)) as entry, min(d) as d, any_value(v) as v from
 (select x.row_id, x.part, x.v, b.entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from x join b{r} b using (part)) group by row_id, part)"""
    moved = """b{n} as materialized (select part, entry, coalesce(m.v, b.v) as v from b{r} b left join
 (select part, entry, list((s - ((s % n) + n) % n) // n order by pos) as v from (select part, entry, pos, sum(y)::bigint as s, count(*) as n from (select part, entry, unnest(v) as y, generate_subscripts(v, 1) as pos from a{r}) group by all) group by part, entry) m using (part, entry))"""
    steps = [nearest.format(r=0)] + [s for r in range(rounds) for s in (moved.format(r=r, n=r + 1), nearest.format(r=r + 1))]
    return f"""
with kept as materialized (select row_number() over () as row_id, vec_id, label, list_transform(embedding, lambda y: floor(4096 * y::double)::bigint) as v from embeddings
 where embedding is not null and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0),
x as materialized (select row_id, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] as v from kept, range({parts}) p(part)),
first as (select vec_id, min(v) as v, row_number() over (order by vec_id) - 1 as entry from kept where vec_id is not null group by vec_id qualify entry < {entries}),
b0 as materialized (select part, entry, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] as v from first, range({parts}) p(part)),
{",".join(steps)},
done as (select row_id, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from a{rounds} group by row_id),
digest as (select sha256(string_agg(y::varchar, ',' order by part, entry, pos)) as codebooks_sha256 from (select part, entry, unnest(v) as y, generate_subscripts(v, 1) as pos from b{rounds}))
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from kept join done using (row_id), digest
"""


ORACLE_SQL = _oracle()
