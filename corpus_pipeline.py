"""A corpus pipeline: language ID, line dedup, SimHash near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of documents; n_chars follows the text where a stage rewrites it. A document whose text becomes empty goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import language_id, line_dedup, packing, passage_dedup, simhash
from latticework.llm.common import stored
from latticework.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in one of the languages learned from the labelled ones; texts without a letter are in none."""
    ship(spark)
    model = language_id.fit(docs)
    return language_id.predict(docs, model).filter("lang_pred <> 'und'").select(COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later occurrences of three-line windows."""
    ship(spark)
    return _rewritten(line_dedup.dedup_lines(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    ship(spark)
    return simhash.keep_one(docs).select(COLUMNS)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later occurrences of passages of 50 words or more."""
    ship(spark)
    return _rewritten(passage_dedup.dedup_passages(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    import public_tokenizers as public

    ship(spark)
    return packing.pack(docs, public.path("word_bpe_49k.json"), 1)


def _rewritten(rows: DataFrame) -> DataFrame:
    changed = F.col("n_removed") > 0
    rows = rows.filter(~changed | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return rows.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast("bigint")).select(COLUMNS)


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("simhash_near_dedup", near_stage), ("substring_dedup", passage_stage), ("packing", packing_stage)]

#: SQL can't express the language model, SimHash components, chaining or the tokenizer; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet in the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
