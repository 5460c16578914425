"""The corpus operators' queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, curves, language_id, line_dedup, packing, passage_dedup, simhash, spelling, suffix_dedup, token_counts, token_files, topk, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.query,
    "op2_simhash": simhash.query,
    "op3_byte_bpe": bpe.query,
    "op4_curves": curves.query,
    "op5_suffix_dedup": suffix_dedup.query,
    "op6_line_dedup": line_dedup.query,
    "op7_token_files": token_files.query,
    "op8_topk": topk.query,
    "op9_passage_dedup": passage_dedup.query,
    "op10_packing": packing.query,
    "op11_vector_codes": vector_codes.query,
    "op12_token_counts": token_counts.query,
    "op13_spelling": spelling.query,
}

ORACLE_SQL: dict[str, str] = {"op6_line_dedup": line_dedup.ORACLE_SQL, "op8_topk": topk.ORACLE_SQL, "op11_vector_codes": vector_codes.ORACLE_SQL, "op13_spelling": spelling.ORACLE_SQL}
