"""The order-free part of the asset fold, kept up to date by a stream of sightings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.keys import asset_key


def live_assets(spark: SparkSession, observations: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Fold streamed ``observations`` by key. Each micro-batch writes the keys it touched as a version of its own; a key's latest version counts.

    A batch that is run again after a failure replaces its own version, so it counts once.
    """
    live = observations.groupBy("type", asset_key(F.col("identifier")).alias("asset_key")).agg(F.count("*").alias("observations"), F.min("seen_us").alias("first_us"), F.max("seen_us").alias("last_us"))

    def write(rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/version={version}")

    live.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    every = spark.read.parquet(target)
    latest = every.groupBy("type", "asset_key").agg(F.max_by(F.struct("observations", "first_us", "last_us"), "version").alias("x"))
    return latest.select("type", "asset_key", "x.*")
