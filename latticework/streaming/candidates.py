"""Candidates whose evidence adds up in a stream until they are promoted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def promoted_candidates(spark: SparkSession, evidence: DataFrame, target: str, checkpoint: str, sure: float = 0.9, signals: int = 2) -> DataFrame:
    """Keys promoted by streamed ``evidence`` (seed_key, source, kind, confidence, reasoned), with the micro-batch that did it first.

    State is one row a key: a flag, a maximum and its few distinct signals. A batch that is run again replaces its rows.
    """
    told = (F.col("source") != "") & (F.col("kind") != "")
    state = evidence.groupBy("seed_key").agg(F.bool_or("reasoned").alias("reasoned"), F.max(F.when(told, F.col("confidence"))).alias("confidence"), F.size(F.collect_set(F.when(told, F.concat_ws("|", "source", "kind")))).alias("signals"))
    fired = state.filter(F.col("reasoned") | (F.coalesce("confidence", F.lit(0.0)) >= sure) | (F.col("signals") >= signals))

    def write(rows: DataFrame, batch: int) -> None:
        rows.select("seed_key").write.mode("overwrite").parquet(f"{target}/batch={batch}")

    fired.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("seed_key string, batch bigint").parquet(target).groupBy("seed_key").agg(F.min("batch").alias("batch"))
