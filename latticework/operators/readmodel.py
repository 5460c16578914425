"""The lineage read model as rows, and small summaries of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Labels of a details line and the registration's fields, in order.
REGISTRATION_LABELS = [
    ("registrar_name", "Registrar"), ("registrar_url", "RegistrarURL"), ("registrant_name", "RegistrantName"), ("registrant_org", "RegistrantOrg"), ("registrant_email", "RegistrantEmail"),
    ("name_servers", "Nameservers"), ("created", "Created"), ("updated", "Updated"), ("expires", "Expires"),
]


def details_line(rows: DataFrame) -> DataFrame:
    """``rows`` (ownership_state, inclusion_reason, status, and what ``fold.merged_details`` gives) with details: all that is known in one line, empty parts left out."""
    told = lambda label, c: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{label} "), c.cast("string")))
    parts = [told("Ownership", F.col("ownership_state")), told("Reason", F.col("inclusion_reason")), told("Resolution", F.col("status"))]
    parts.append(told("DNS", F.array_join(F.transform("records", lambda r: F.concat(r["type"], F.lit(":"), r["value"])), "; ")))
    parts.append(F.when(F.col("is_catch_all"), "Catch-all"))
    kinds = {f.name: f.dataType.typeName() for f in rows.schema["rdap"].dataType.fields}
    for name, label in REGISTRATION_LABELS:
        if name in kinds:
            c = F.col(f"rdap.{name}")
            parts.append(told(label, F.array_join(c, ", ") if kinds[name] == "array" else F.date_format(c, "yyyy-MM-dd") if kinds[name] in ("timestamp", "date") else c))
    parts += [told("ASN", F.nullif(F.col("asn"), F.lit(0))), told("Org", F.col("organization")), told("PTR", F.col("ptr")), told("CIDR", F.try_element_at("data", F.lit("cidr")))]
    return rows.withColumn("details", F.concat_ws(" | ", *parts))


def trace_sections(assets: DataFrame) -> DataFrame:
    """Evidence lines of each asset by section, empty ones removed: (asset_id, title, position, item)."""
    line = lambda text, c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{text}: "), F.col(c).cast("string")))
    sections = {
        "Result": [("Asset ID", "asset_id"), ("Asset type", "type"), ("Contributors", "all_sources"), ("Discovered by", "discovery_sources"), ("Enriched by", "enrichment_sources")],
        "Ownership": [("Ownership state", "ownership_state"), ("Inclusion reason", "inclusion_reason")],
    }
    every = F.array(*(F.struct(F.lit(title).alias("title"), F.array_compact(F.array(*(line(*x) for x in items))).alias("items")) for title, items in sections.items()))
    rows = assets.select("asset_id", F.explode(every).alias("s")).filter("size(s.items) > 0")
    return rows.select("asset_id", "s.title", F.posexplode("s.items").alias("position", "item"))


def enrichment_summary(stages: DataFrame) -> DataFrame:
    """Per asset its stages and how often each status occurs."""
    counts = stages.groupBy("asset_id", "status").agg(F.count("*").alias("n"), F.max("updated_us").alias("at"), F.collect_set("stage").alias("s"))
    told = F.transform(F.array_sort(F.collect_list(F.struct("status", "n"))), lambda x: F.format_string("%s (%d)", x.status, x.n))
    return counts.groupBy("asset_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))), ",").alias("stages"), F.array_join(told, ", ").alias("statuses"), F.max("at").alias("latest_us"))


def roots_by_label(roots: DataFrame) -> DataFrame:
    """Roots (root) by the label before their public suffix."""
    return roots.groupBy(F.substring_index("root", ".", 1).alias("label")).agg(F.array_join(F.array_sort(F.collect_set("root")), ",").alias("roots"))


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates of a seed by links, then referrers, then name."""
    w = Window.partitionBy("seed_id").orderBy(F.desc("links"), F.desc("referrers"), "root")
    return candidates.withColumn("rank", F.row_number().over(w))


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The next version of a table: rows of ``incoming`` replace those with the same key."""
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)
