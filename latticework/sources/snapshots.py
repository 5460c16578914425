"""Versioned snapshots of a run's tables, and exports of its assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_snapshot(spark: SparkSession, path: str, version: int, tables: dict[str, DataFrame]) -> None:
    """Write each table as a version, and the pointer to the version last: a snapshot that broke off is never read."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/v={version}/{name}")
    spark.createDataFrame([(version, ",".join(sorted(tables)))], "version int, tables string").coalesce(1).write.mode("append").parquet(f"{path}/pointer")


def load_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the newest complete version."""
    top = spark.read.parquet(f"{path}/pointer").orderBy(F.desc("version")).first()
    return {name: spark.read.parquet(f"{path}/v={top['version']}/{name}") for name in top["tables"].split(",")}


def export_tables(assets: DataFrame, records: DataFrame, registrations: DataFrame, origins: DataFrame) -> dict[str, DataFrame]:
    """The three export tables: registrable domains with registration, other hosts with records by type, addresses with network.

    ``assets``: asset_id, domain_kind, root, asset_key, sources, date. ``records``: asset_key, record_type, value.
    ``registrations``: as the sources give them. ``origins``: ip, asn, organization, ptr, cidr.
    """
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("")).alias(c)
    domains = assets.filter("domain_kind = 'registrable'").join(registrations.withColumnRenamed("domain", "asset_key"), "asset_key", "left")
    domains = domains.select("asset_id", F.col("asset_key").alias("registrable_domain"), "sources", "date", F.coalesce("registrar_name", F.lit("")).alias("registrar"), day("created"), day("updated"), day("expires"), F.coalesce("registrant_org", F.lit("")).alias("registrant_org"), F.coalesce(F.array_join("name_servers", ", "), F.lit("")).alias("nameservers"))
    kinds = ["A", "AAAA", "CNAME", "MX", "TXT"]
    lists = records.groupBy("asset_key").agg(*(F.array_join(F.array_sort(F.collect_set(F.when(F.upper("record_type") == k, F.col("value")))), ", ").alias(k.lower()) for k in kinds))
    hosts = assets.filter("domain_kind = 'subdomain'").join(lists, "asset_key", "left")
    hosts = hosts.select("asset_id", F.col("root").alias("registrable_domain"), F.col("asset_key").alias("hostname"), "sources", "date", *(F.coalesce(k.lower(), F.lit("")).alias(k.lower()) for k in kinds))
    ips = assets.filter("domain_kind = 'ip'").join(origins.withColumnRenamed("ip", "asset_key"), "asset_key", "left")
    ips = ips.select("asset_id", F.col("asset_key").alias("ip"), "sources", "date", "asn", "organization", "ptr", "cidr")
    return {"registrable_domains": domains, "subdomains": hosts, "ips": ips}
