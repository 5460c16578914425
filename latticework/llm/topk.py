"""Exact top-k search by tiled matrix products (operator 8).

Queries are dealt into blocks and all rows into shards. Each (block, shard) tile is one matrix product in a task, which
keeps each query's best rows of that tile (partial selection); the lists then merge as a tree, a few shards at a time.
Tiles are dealt by hashes of ids, so equal vectors are no group. All the work is queries times rows by contract.

Components become floor(256 * x), integers that doubles hold exactly. Products are computed in doubles while no sum can reach
2**53, so they are exact; in 64-bit integers while none can reach 2**63; else in integers without a bound, which is slow. A
component of which 256 times is no finite double, or a result that is no 64-bit integer, is an error that says so. Null vectors, null ids and vectors with null or non-finite components take no part; nor
do vectors of another length than most. Rows that repeat an id and vector count once, and rows that share a query's id
are its own. No rows give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column_np, stored
from .curves import best

#: Rows of a shard, queries of a block, lists that one step of the tree merges.
SHARD, BLOCK, FAN_IN = 8192, 2048, 8


def finite(vector: Column) -> Column:
    return F.coalesce(F.forall(vector.cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def scaled(x: Column, scale: int) -> Column:
    """floor(scale * x) as a double: from 2**52 on doubles are integers."""
    y = x.cast("double") * scale
    whole = F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)
    return F.when(F.abs(y) < float("inf"), whole).otherwise(F.raise_error(F.lit("a component is too large for a finite product with the scale")))


def top(scores: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, ident: str = "vec_id", vector: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Per query (a row whose id is divisible by ``every``) the ``k`` other rows of largest integer inner product."""
    rows = vectors.filter(finite(F.col(vector))).select(F.col(ident).cast("bigint").alias("id"), F.transform(vector, lambda x: scaled(x, scale)).alias("v"))
    rows = stored(rows.filter("id is not null").distinct(), "integers")
    n, asked, dim, most = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0), F.mode(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    rows, reach = rows.filter(F.size("v") == (dim or 0)), int(most or 0) ** 2 * (dim or 0)  # no sum is larger
    shards, blocks = max(1, -(-n // shard)), max(1, -(-asked // block))
    tile = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    cells = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    queries = rows.filter(F.col("id") % every == 0).select(tile(blocks).alias("b"), cells(shards).alias("s"), "id", "v")
    data = rows.select(cells(blocks).alias("b"), tile(shards).alias("s"), "id", "v")

    def product(q: pa.Table, d: pa.Table) -> pa.Table:
        def mat(t: pa.Table) -> np.ndarray:
            v = np.asarray(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, dim)
            if reach < 2**53:
                return v
            return v.astype(np.int64) if reach < 2**63 else np.array([[int(x) for x in row] for row in v.tolist()], object).reshape(v.shape)

        def longs(scores: np.ndarray) -> np.ndarray:
            if any(not -(2**63) <= x < 2**63 for x in scores.tolist()):
                raise ValueError("a score is no 64-bit integer")
            return scores.astype(np.int64)

        qi, di, s = column_np(q, "id"), column_np(d, "id"), np.full(q.num_rows, column_np(q, "s")[0] if q.num_rows else 0, np.int32)
        out: list[list[np.ndarray]] = [[], [], [], []]
        if q.num_rows and d.num_rows:
            dm, qm = mat(d), mat(q)
            for at in range(0, len(qm), 256):
                scores = qm[at : at + 256] @ dm.T
                for i, row in enumerate(scores, at):
                    own = di != qi[i]
                    near, ids = row[own], di[own]
                    t = best(near, ids, k)
                    for col, x in zip(out, (np.full(len(t), qi[i]), ids[t], longs(near[t]), np.full(len(t), s[0])), strict=True):
                        col.append(x)
        cat = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
        return pa.table({"query_id": cat(out[0], pa.int64()), "vec_id": cat(out[1], pa.int64()), "score": cat(out[2], pa.int64()), "s": cat(out[3], pa.int32())})

    lists = queries.groupBy("b", "s").cogroup(data.groupBy("b", "s")).applyInArrow(product, "query_id bigint, vec_id bigint, score bigint, s int").distinct()
    while shards > FAN_IN:
        lists, shards = top(lists.withColumn("s", F.floor(F.col("s") / FAN_IN).cast("int")), ["query_id", "s"], k), -(-shards // FAN_IN)
    return top(lists, ["query_id"], k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every fiftieth row asks for its 5 best."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
with v as (select distinct vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
           where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, d.vec_id, cast(list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])) as bigint) as score
           from v q join v d on q.vec_id % 50 = 0 and q.vec_id <> d.vec_id),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""
