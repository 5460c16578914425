"""Token ids in ORC files (operator 7).

Documents are dealt into ranges of doc_id and sorted before they are tokenized, so only texts are shuffled and each
range becomes one file in ascending doc_id order. Ids are an ORC list of integers (run-length encoded stripes); doc_id
has row indexes and a Bloom filter, so a reader of some documents skips stripes and row groups by metadata. Each row
holds the ids before it in its file; the ids before the file are summed from the files themselves when they are read.

A null text counts as empty (the end id alone); null doc_ids come first; rows that repeat a doc_id keep the order of
their texts, nulls first. An empty table gives files without rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import add_columns, list_array, small_batches, table_path
from .word_tokens import encoder

STRIPE, ROWS_INDEXED, FALSE_POSITIVES = 64 << 20, 1000, 0.01
SCHEMA = "doc_id bigint, start_in_file bigint, n_tokens bigint, ids array<int>"


def write(docs: DataFrame, path: str, tokenizer: str, end: int, stripe: int = STRIPE) -> None:
    """Write each document's ids, ``end`` last, to ORC files below ``path``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def tokens(batches):
        e, before = encoder(tokenizer), 0
        for b in batches:
            ids = [np.frombuffer(e.encode(t, end), "<u4") for t in b.column(1).to_pylist()]
            if ids:
                n = np.array([len(x) for x in ids], np.int64)
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(starts), pa.array(n), list_array(np.concatenate(ids).view(np.int32), n, pa.int32())], names=["doc_id", "start_in_file", "n_tokens", "ids"])

    (rows.mapInArrow(tokens, SCHEMA).write.option("compression", "zstd").option("orc.stripe.size", stripe).option("orc.row.index.stride", ROWS_INDEXED)
     .option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", FALSE_POSITIVES).orc(path))


def read(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """The files' rows: doc_id, start_in_file, n_tokens, ids, file. ``only``: some doc_ids, found by the files' indexes."""
    rows = spark.read.schema(SCHEMA).orc(path).withColumn("file", F.col("_metadata.file_name"))
    return rows if only is None else rows.filter(F.col("doc_id").isin(only))


def file_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset): the ids in all files before each one; one row for each file."""
    files = read(spark, path).groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("d"))
    w = Window.orderBy(F.col("d").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    small_batches(spark)

    def make(b: pa.RecordBatch) -> dict[str, pa.Array]:
        ids = b.column(b.schema.get_field_index("ids"))
        off, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<i4")
        return {"ids_crc32": pa.array([zlib.crc32(flat[a:z].tobytes()) for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.int64())}

    slim = add_columns(read(spark, path), make, "ids_crc32 bigint", drop=["ids"])
    return slim.join(file_offsets(spark, path), "file").select("doc_id", (F.col("offset") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: write every document's ids, end id 2, and read the files back."""
    import public_tokenizers as public

    path = table_path(spark, "token_ids")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public.path("word_bpe_49k.json"), 2)
    return digests(spark, path)
