"""Helpers that the corpus operators share: shared storage, row keys, Arrow batches, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import folder

#: Rows in one Arrow batch sent to Python: texts are long, so fewer than Spark's default.
BATCH_ROWS = 1024


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``session.folder``)."""
    return f"{folder(spark)}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: cuts the lineage and survives the loss of executors."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what was made from them is stored itself."""
    for df in tables:
        jvm, at = df.sparkSession._jvm, {x.rsplit("/", 1)[0] for x in df.inputFiles()}
        for path in (jvm.org.apache.hadoop.fs.Path(x) for x in at):
            path.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Keep an Arrow batch of long texts small enough for a Python worker: few rows; bytes have a bound of Spark's own, of which 64 MB is the default."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Column names made from the stems that ``df`` does not use, whatever their case."""
    used = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in used:
            stem += "_"
        used.add(stem.lower())
        out.append(stem)
    return out


def text_key(text: Column) -> Column:
    """16 bytes that identify a whole text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that identify (doc_id, text): rows that repeat both are one document; nulls are allowed."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\x00"), F.coalesce(text, F.lit(""))).cast("binary")))


def add_columns(df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, pa.Array]], schema: str, drop: Iterable[str] = ()) -> DataFrame:
    """``df`` with columns that ``make`` derives from each Arrow batch; columns of the same name are replaced, those in ``drop`` go."""
    new = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    taken = {f.name.lower() for f in new.fields} | {x.lower() for x in drop}
    keep = [f for f in df.schema.fields if f.name.lower() not in taken]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                made = make(b)
                cols = [b.column(b.schema.get_field_index(n)) for n in names] + [made[f.name] for f in new.fields]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *(f.name for f in new.fields)])

    return df.mapInArrow(run, T.StructType(keep + new.fields))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of equal ``keys`` from batches sorted by them; a group must fit in memory."""
    carry: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        starts = group_starts(pa.Table.from_batches([b]), keys)
        same = bool(carry) and all(carry[-1].column(k)[carry[-1].num_rows - 1].as_py() == b.column(k)[0].as_py() for k in keys)
        if len(starts) == 1 and same:
            carry.append(b)
            continue
        cut = int(starts[-1])
        if carry and not same and cut == 0:
            yield pa.Table.from_batches(carry)
            carry = [b]
            continue
        if cut:
            yield pa.Table.from_batches([*carry, b.slice(0, cut)])
        carry = [b.slice(cut)]
    if carry:
        yield pa.Table.from_batches(carry)


def column_np(t: pa.Table, name: str) -> np.ndarray:
    c = t.column(name)
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    if isinstance(c, pa.ChunkedArray):
        c = pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)
    return c.to_numpy(zero_copy_only=False)


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Indexes at which a new group of equal ``keys`` begins."""
    new = np.zeros(t.num_rows, bool)
    if t.num_rows:
        new[0] = True
    for k in keys:
        v = column_np(t, k)
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def binary_rows(t: pa.Table, name: str, width: int) -> np.ndarray:
    """A binary column of fixed ``width`` as a matrix of bytes."""
    c = t.column(name).combine_chunks()
    c = pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
    off = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
    return np.frombuffer(c.buffers()[2], np.uint8)[off[0] : off[-1]].reshape(len(c), width)


def to_binary(rows: np.ndarray) -> pa.Array:
    """A matrix of bytes as an Arrow binary column."""
    rows = np.ascontiguousarray(rows, np.uint8)
    off = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(off), pa.py_buffer(rows)])


def list_array(values: np.ndarray, counts: Iterable[int], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.fromiter(counts, np.int64))]).astype(np.int32)), pa.array(values, kind))


def components(edges: DataFrame) -> DataFrame:
    """Connected components: ``edges`` (src, dst) of any orderable type to rows (node, component), component being the smallest node.

    Alternating large-star and small-star rounds; each writes a table in the shared folder. Minima are combined
    before the shuffle and the join with them can be split, so a node with very many links is no bottleneck.
    Nodes without links to others don't appear. Rounds go on until every node points to its component (their number
    grows with the logarithm of the longest path); each one's table goes when the next is written.
    """
    def larger_first(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).filter("src > dst").distinct()

    e = stored(larger_first(edges), "edges")
    while True:
        before = e
        both = e.union(e.select("dst", "src"))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        e = both.join(low, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).filter("src > dst").distinct()
        low = e.groupBy("src").agg(F.min("dst").alias("m"))
        e = stored(larger_first(e.join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(low.select("src", F.col("m").alias("dst")))), "edges")
        remove(before)
        if e.select(F.col("dst").alias("src")).join(e.select("src"), "src", "left_semi").isEmpty() and e.groupBy("src").count().filter("count > 1").isEmpty():
            break
    roots = e.select(F.col("dst").alias("node")).distinct()
    return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots.select("node", F.col("node").alias("component")))
