"""An append-only log of events as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_events(spark: SparkSession, source: str, target: str, checkpoint: str) -> DataFrame:
    """Stream the events at ``source`` into a Parquet log, dropping those of blank type, and read the log."""
    schema = spark.read.parquet(source).schema
    folder, _, name = source.rstrip("/").rpartition("/")
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else spark.readStream.schema(schema).parquet(source)
    kept = events.filter(F.trim("event_type") != "").withColumn("kind", F.lower("event_type"))
    kept.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)
