"""Rows from captured raw responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.keys import host_key, ip_bits, is_ip4, trimmed, url_host
from latticework.sources.markup import sitemap_rows

#: Patterns of a host name with several labels, and of a body that is an error.
HOST = r"^([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z0-9]([a-z0-9-]*[a-z0-9])?$"
ERROR = r"(?i)^error |api count exceeded|quota exceeded"


def host_search_rows(bodies: DataFrame) -> DataFrame:
    """From bodies (seed_id, body) of ``host,ip`` lines: one row per accepted host and one per address (of either kind) beside it; error bodies give none."""
    lines = bodies.filter(~F.trim("body").rlike(ERROR)).select("seed_id", F.explode(F.split("body", r"\r?\n")).alias("line"))
    parts = F.split("line", ",", 2)
    rows = lines.select("seed_id", host_key(parts[0]).alias("host"), trimmed(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("ip"))
    rows = rows.filter(F.col("host").rlike(HOST) & ~is_ip4(F.col("host")))
    found = F.array_compact(F.array(F.struct(F.lit("domain").alias("type"), F.col("host").alias("identifier")), F.when(ip_bits(F.col("ip")).isNotNull(), F.struct(F.lit("ip").alias("type"), F.lower("ip").alias("identifier")))))
    return rows.select("seed_id", F.explode(found).alias("x")).select("seed_id", "x.type", "x.identifier")


def rejected_bodies(bodies: DataFrame) -> DataFrame:
    """Bodies that are errors, with their first line."""
    return bodies.filter(F.trim("body").rlike(ERROR)).select("seed_id", F.split("body", "\n")[0].alias("error"))


def archive_hosts(urls: DataFrame) -> DataFrame:
    """Distinct hosts of archived URLs (url)."""
    return urls.select(url_host(F.col("url")).alias("host")).filter(F.col("host").rlike(HOST)).distinct()


def ct_names(bodies: DataFrame) -> DataFrame:
    """Distinct names (case counts) of certificate logs: JSON arrays of records whose name_value holds one name a line."""
    lines = F.flatten(F.transform(F.from_json("body", "array<struct<name_value string>>"), lambda r: F.split(F.coalesce(r.name_value, F.lit("")), "\n")))
    names = F.array_distinct(F.transform(lines, lambda n: F.regexp_replace(trimmed(n), r"^\*\.", "")))
    # an outer explosion adds no filter that would read the body again
    return bodies.select("seed_id", F.explode_outer(names).alias("name")).filter("name <> ''").distinct()


def sitemap_locs(bodies: DataFrame) -> DataFrame:
    """Locations of sitemaps and of indexes of sitemaps."""
    return sitemap_rows(bodies, ["seed_id"]).filter("error is null").select("seed_id", "loc")


def sitemap_errors(bodies: DataFrame) -> DataFrame:
    """Bodies that are no sitemaps, with the reason."""
    return sitemap_rows(bodies, ["seed_id"]).filter("error is not null").select("seed_id", "error")
