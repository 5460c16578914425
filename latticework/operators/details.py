"""Details of assets, outbound roots, address budgets and replaced sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: States of an enrichment stage by priority.
STAGES = ["failed", "retryable", "cached", "completed"]


def asset_details(rows: DataFrame) -> DataFrame:
    """Per type and asset_key: distinct records in order, the last value, and the stage of highest priority (the later of equal ones)."""
    priority = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    record = F.struct(F.upper("record_type").alias("t"), F.lower("record").alias("v"))
    return rows.groupBy("type", "asset_key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(record)), lambda x: F.concat(x.t, F.lit(" "), x.v)), ", ").alias("records"),
        F.max_by("value", F.when(F.col("value").isNotNull(), F.col("seq"))).alias("last_value"), F.max_by("stage", F.struct(priority, "seq")).alias("stage"),
    )


def ip_edges(records: DataFrame) -> DataFrame:
    """From records (enumeration_id, domain, ip, seq): one edge per enumeration and address, from the domain that showed it first, by the address's kind."""
    rows = records.groupBy("enumeration_id", F.lower("ip").alias("ip")).agg(F.min_by("domain", "seq").alias("domain"))
    return rows.withColumn("kind", F.when(F.col("ip").contains(":"), "dns_aaaa").otherwise("dns_a"))


def outbound_roots(links: DataFrame, samples: int = 5) -> DataFrame:
    """Per seed and root: links, distinct referrers, first distinct samples, and the confidence of that evidence."""
    by = ["seed_id", "root"]
    counts = links.groupBy(*by).agg(F.count("*").alias("links"), F.count_distinct("referrer").alias("referrers"), F.count_if(F.col("relation") != "").alias("related"))
    seen = links.groupBy(*by, "sample").agg(F.min("seq").alias("at"))
    top = seen.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("at", "sample"))).filter(F.col("r") <= samples)
    top = top.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "sample"))), lambda x: x.sample), ",").alias("samples"))
    confidence = F.round(F.least(F.lit(0.85), 0.45 + 0.05 * F.col("referrers") + F.when(F.col("related") > 0, 0.05).otherwise(0.0)), 2)
    return counts.join(top, by).select(*by, "links", "referrers", "samples", confidence.alias("confidence"))


def ip_budget(prefixes: DataFrame, per_prefix: int = 256, per_seed: int = 512) -> DataFrame:
    """Addresses (seed_id, n) of prefixes (seed_id, pos, base, len) in prefix order, within both budgets.

    A running sum over prefixes says how many of each fit, so no address beyond a budget is ever made.
    """
    size = F.least(F.expr("shiftleft(1L, 32 - len)"), F.lit(per_prefix))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("seed_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = prefixes.withColumn("size", size).withColumn("take", F.least("size", F.lit(per_seed) - before)).filter("take > 0")
    return rows.select("seed_id", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("take") - 1)).alias("n"))


def issue_counts(issues: DataFrame) -> DataFrame:
    """Per kind the number of issues and the first."""
    return issues.groupBy("kind").agg(F.count("*").alias("issues"), F.min_by("sample", "seq").alias("first"))


def sync_actions(existing: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """What replaces a set by another: each key with upsert, or delete where it is no longer wanted."""
    both = existing.select(key, F.lit(True).alias("e")).join(wanted.select(key, F.lit(True).alias("w")), key, "full_outer")
    return both.select(key, F.when(F.col("w"), "upsert").otherwise("delete").alias("action"))
