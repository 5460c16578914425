"""The whole asset fold kept up to date by a stream of sightings: new ones touch only the states of their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.functions.keys import asset_key, trimmed
from latticework.operators.fold import finished, fold_states
from latticework.operators.stored_fold import SIGHTING

KEY = ["type", "asset_key"]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def live_fold(spark: SparkSession, observations: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Canonical assets of all that ``observations`` (a stream with the columns of a sighting) has brought.

    The fold is a streaming aggregate, which map tasks combine before its states, so a key with very many sightings is no large group. Beside it in the same
    stream, distinct provenance is kept by a streaming deduplication, dealt by its digest too. Each micro-batch writes the states it touched, and how many
    new provenances each key got, as a version below ``target``; a batch that runs again after a failure replaces its own. The result is that of
    ``canonical_assets`` over all sightings, in whatever batches and order they came. Sightings without seq or identifier fold like others
    under a null key; none at all give no assets.
    """
    folded = fold_states(observations)
    digest = F.unhex(F.sha2(F.to_json(F.struct("id", "enumeration_id", "source", "seen_us")), 256))
    seen = observations.filter("kind = 'discovery'").select("type", asset_key(F.col("identifier")).alias("asset_key"), digest.alias("digest")).dropDuplicates()
    told = folded.select(*KEY, F.struct(*(c for c in folded.columns if c not in KEY)).alias("state"), F.lit(0).alias("fresh"))
    live = told.union(seen.select(*KEY, F.lit(None).cast(told.schema["state"].dataType), F.lit(1)))

    def write(rows: DataFrame, version: int) -> None:
        rows.groupBy(*KEY).agg(F.first("state", ignorenulls=True).alias("state"), F.sum("fresh").alias("n_provenance")).write.mode("overwrite").parquet(f"{target}/version={version}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        started = live.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        started.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return finished(states(spark, target))


def states(spark: SparkSession, target: str) -> DataFrame:
    """The latest state of each key, with the number of its distinct provenances in all versions."""
    fields = [f for f in fold_states(spark.createDataFrame([], SIGHTING)).schema.fields if f.name not in KEY]
    schema = f"type string, asset_key string, state {T.StructType(fields).simpleString()}, n_provenance bigint, version bigint"
    latest = spark.read.schema(schema).parquet(target).groupBy(*KEY).agg(F.max_by("state", F.when(F.col("state").isNotNull(), F.col("version"))).alias("s"), F.sum("n_provenance").alias("n_provenance"))
    return latest.select(*KEY, "s.*", "n_provenance")
