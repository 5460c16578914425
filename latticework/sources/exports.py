"""Flat exports of assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the flat export.
CSV_COLUMNS = ["Asset ID", "Domain Kind", "Registrable Domain", "Type", "Identifier", "Source", "Date"]


def formatted_time(micros: Column) -> Column:
    """A moment (microseconds) as text; empty if there is none."""
    return F.coalesce(F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def write_csv(assets: DataFrame, order: list[str], path: str) -> None:
    """Assets (asset_id, domain_kind, root, type, asset_key, sources, first_seen_us, and the columns of ``order``) as CSV files that follow one another in that order."""
    root = F.when(F.col("type") == "ip", "").otherwise(F.col("root"))
    values = ["asset_id", "domain_kind", root, "type", "asset_key", "sources", formatted_time(F.col("first_seen_us"))]
    rows = assets.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select(*((F.col(v) if isinstance(v, str) else v).alias(n) for v, n in zip(values, CSV_COLUMNS, strict=True))).write.csv(path, header=True)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(", ".join(f"`{c}` string" for c in CSV_COLUMNS)).csv(path, header=True).na.fill("")
