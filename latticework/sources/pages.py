"""Links and titles of captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.keys import link_relation, normalized_url, squeezed, url_host
from latticework.functions.names import resolve_url
from latticework.sources.markup import elements


def fetchable(pages: DataFrame) -> DataFrame:
    """Captured answers (status, content_type) that are pages: no error, HTML or without a type."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    return pages.filter((F.col("status") < 400) & ((kind == "") | kind.contains("text/html") | kind.contains("application/xhtml+xml")))


def page_links(pages: DataFrame, most: int = 128) -> DataFrame:
    """One row per link of a page (page_id, url, html), in document order: resolved and normalized target, its host, text, relation, nofollow,
    and the page's title. Links that lead nowhere on the web, and those that repeat target, relation and text (whatever its case), don't count;
    of the others the first ``most`` of a page stay."""
    rows = elements(pages, ["page_id", "url"])
    titles = rows.filter("tag = 'title'").withColumn("title", squeezed(F.col("text"))).filter("title <> ''").groupBy("page_id", "url").agg(F.min_by("title", "pos").alias("title"))
    links = rows.filter("tag = 'a'").withColumn("target_url", normalized_url(resolve_url(F.col("url"), F.col("href")))).filter("target_url is not null").withColumn("anchor_text", squeezed(F.col("text")))
    links = links.withColumn("relation", link_relation(F.coalesce(normalized_url(F.col("url")), F.lit("")), F.col("target_url"), F.col("anchor_text"))).withColumn("nofollow", F.lower("rel").contains("nofollow"))
    first = links.groupBy("page_id", "url", "target_url", "relation", F.lower("anchor_text").alias("low")).agg(F.min(F.struct("pos", "anchor_text", "nofollow")).alias("x"))
    ranked = first.withColumn("pos", F.row_number().over(Window.partitionBy("page_id", "url").orderBy("x.pos")) - 1).filter(F.col("pos") < most)
    out = ranked.join(titles, ["page_id", "url"], "left")
    return out.select("page_id", "url", F.coalesce("title", F.lit("")).alias("title"), "pos", "target_url", url_host(F.col("target_url")).alias("target_host"), "x.anchor_text", "relation", "x.nofollow")
