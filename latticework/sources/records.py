"""Rows from captured JSON, text and markup answers. Every input has one body a row; unreadable bodies give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.functions.keys import attach_root, once, trimmed
from latticework.functions.names import domain_candidates, resolve_url
from latticework.session import stored
from latticework.sources.markup import elements

SEED = "id string, company_name string, domains array<string>, asn array<int>, cidr array<string>, address string, industry string, tags array<string>, confidence double"


def load_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seeds of JSON files that hold arrays of them; unknown fields are ignored, those with neither domain nor company go."""
    rows = spark.read.schema(SEED).json(path, multiLine=True)
    known = (F.trim(F.coalesce("company_name", F.lit(""))) != "") | (F.size(F.coalesce("domains", F.array().cast("array<string>"))) > 0)
    return rows.filter(known).withColumn("id", F.coalesce(F.nullif(F.trim("id"), F.lit("")), F.sha2(F.to_json(F.struct("company_name", "domains")), 256)))


def ct_term_names(bodies: DataFrame) -> DataFrame:
    """Distinct host names of certificate searches: common names, and each line of the name values."""
    # outer explosions add no filters that would read a body again; a body's values are read once each
    told = lambda r: F.concat(F.array(F.coalesce(r.common_name, F.lit(""))), F.split(F.coalesce(r.name_value, F.lit("")), "\n"))
    raw = F.array_distinct(F.flatten(F.transform(F.from_json("body", "array<struct<common_name string, name_value string>>"), told)))
    names = F.array_distinct(F.flatten(F.transform(raw, lambda x: domain_candidates(x))))
    return bodies.select("seed_id", F.explode_outer(names).alias("name")).filter("name is not null").distinct()


def passive_dns_hosts(bodies: DataFrame) -> DataFrame:
    """Every host name of passive DNS answers as it is; repeats stay."""
    r = bodies.select("seed_id", F.explode(F.from_json("body", "passive_dns array<struct<hostname string>>").passive_dns.hostname).alias("host"))
    return r.filter("host <> ''")


def announced_prefixes(bodies: DataFrame) -> DataFrame:
    """Distinct prefixes announced by a network."""
    r = bodies.select("seed_id", F.explode(F.from_json("body", "data struct<prefixes array<struct<prefix string>>>").data.prefixes.prefix).alias("p"))
    return r.select("seed_id", F.lower(trimmed(F.col("p"))).alias("prefix")).filter("prefix <> ''").distinct()


def robots_sitemaps(bodies: DataFrame) -> DataFrame:
    """Sitemaps named in robots files (base, body); of spellings that differ in case of scheme and host the first stays."""
    # each line is read once: outer explosions add no filters that would read it again
    lines = bodies.select("base", F.posexplode_outer(F.filter(F.transform(F.split("body", r"\r?\n"), trimmed), lambda x: x.rlike("(?i)^sitemap:"))).alias("pos", "line"))
    urls = lines.select("base", "pos", F.explode_outer(F.array(resolve_url(F.col("base"), F.regexp_replace("line", "(?i)^sitemap:", "")))).alias("url")).filter("url is not null")
    site = F.regexp_extract("url", "^[A-Za-z]+://[^/?#]*", 0)
    return urls.groupBy("base", F.concat(F.lower(site), F.regexp_replace("url", "^[A-Za-z]+://[^/?#]*", "")).alias("k")).agg(F.min_by("url", "pos").alias("url")).select("base", "url")


#: Keys of a security file whose values are links.
SECURITY_KEYS = ["canonical", "contact", "policy", "hiring"]


def securitytxt_links(bodies: DataFrame) -> DataFrame:
    """Links of security files (seed_id, body), by key."""
    lines = bodies.select("seed_id", F.explode(F.transform(F.split("body", r"\r?\n"), trimmed)).alias("line")).filter("line like '%:%' and line not like '#%'")
    parts = F.split("line", ":", 2)
    return lines.select("seed_id", F.lower(trimmed(parts[0])).alias("key"), trimmed(parts[1]).alias("link")).filter(F.col("key").isin(SECURITY_KEYS) & (F.col("link") != ""))


def ownership_hint_links(pages: DataFrame) -> DataFrame:
    """Links of pages (page_id, html) that hint at an owner: canonical and alternate links, the page's own URL, anchors with their text; pos is the
    place among the page's elements."""
    tag, rel = F.col("tag"), F.col("rel")
    text = F.when((tag == "link") & rel.contains("canonical"), F.array(F.lit("canonical"))).otherwise(F.array().cast("array<string>"))
    other = F.when((tag == "link") & rel.contains("alternate") & (F.col("hreflang") != ""), "alternate").when((tag == "meta") & F.array_contains(F.split(F.lower("property"), " "), "og:url"), "canonical").when(tag == "a", trimmed(F.col("text")))
    rows = elements(pages, ["page_id"]).select("page_id", "pos", trimmed(F.col("href")).alias("raw"), F.explode(F.array_compact(F.concat(text, F.array(other)))).alias("text"))
    return rows.filter("raw <> ''")


def _object(body: Column) -> Column:
    """The outermost braces of a text, fenced or not."""
    return F.regexp_extract(body, r"(?s)\{.*\}", 0)


ANSWER = "queries array<string>, candidates array<struct<root string, summary string, evidence array<struct<title string, url string, snippet string>>>>"


def search_candidates(bodies: DataFrame, rules: DataFrame, most: int = 10, evidence: int = 3) -> DataFrame:
    """Candidates of search answers (seed_id, body): the first of each registrable root with a summary and evidence, ``most`` per answer.

    Evidence needs title, snippet and an http(s) URL; the first ``evidence`` of distinct URLs stay, in order of URL and title.
    """
    c = bodies.select("seed_id", F.posexplode_outer(F.from_json(_object(F.col("body")), ANSWER).candidates).alias("pos", "c"))
    told = F.transform(F.col("c.evidence"), lambda e: F.struct(trimmed(e.url).alias("url"), trimmed(e.title).alias("title"), trimmed(e.snippet).alias("snippet")))
    counts = F.filter(told, lambda e: (e.title != "") & (e.snippet != "") & e.url.rlike("(?i)^https?:"))
    fresh = lambda es: once(F.transform(es, lambda e: e.url), lambda urls: F.filter(es, lambda e, i: F.array_position(urls, e.url) == i + 1))
    good = c.select("seed_id", "pos", F.explode_outer(F.array(F.struct(F.lower(trimmed(F.col("c.root"))).alias("host"), trimmed(F.col("c.summary")).alias("summary"), F.array_sort(F.slice(once(counts, fresh), 1, evidence)).alias("e")))).alias("g"))
    good = stored(good.select("seed_id", "pos", "g.*").filter("size(e) > 0 and summary <> '' and host <> ''"), "candidates")  # read for the roots and with them
    rooted = attach_root(good, "host", rules)
    first = rooted.withColumn("n", F.row_number().over(Window.partitionBy("seed_id", "root").orderBy("pos"))).filter("n = 1")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("seed_id").orderBy("pos"))).filter(F.col("rank") <= most)
    return ranked.select("seed_id", "rank", "root", "summary", F.col("e").alias("evidence"))


def search_queries(bodies: DataFrame, most: int = 5) -> DataFrame:
    """Queries that an answer reports: the first spelling of each, ``most`` per answer, in order."""
    asked = F.filter(F.transform(F.from_json(_object(F.col("body")), "queries array<string>").queries, trimmed), lambda x: x != "")
    first = lambda q: once(F.transform(q, F.lower), lambda low: F.filter(q, lambda x, i: F.array_position(low, F.lower(x)) == i + 1))
    return bodies.select("seed_id", F.posexplode_outer(F.slice(once(asked, first), 1, most)).alias("pos", "query")).filter("query is not null")


DECISIONS = "decisions array<struct<root string, collect boolean, confidence double, kind string, reason string>>"


def decisions_from_text(bodies: DataFrame, rules: DataFrame) -> DataFrame:
    """Decisions in answers (seed_id, body): the last of each registrable root, its confidence within 0 and 1."""
    d = bodies.select("seed_id", F.posexplode_outer(F.from_json(_object(F.col("body")), DECISIONS).decisions).alias("pos", "d")).select("seed_id", "pos", "d.*")
    told = stored(d.withColumn("host", F.lower(trimmed(F.col("root")))).drop("root").filter("host <> ''"), "decisions")  # read for the roots and with them
    rooted = attach_root(told, "host", rules)
    value = F.struct(F.coalesce("collect", F.lit(False)).alias("collect"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))).alias("confidence"), "kind", "reason")
    return rooted.groupBy("seed_id", "root").agg(F.max_by(value, "pos").alias("x")).select("seed_id", "root", "x.*")


def ip_origin_rows(answers: DataFrame) -> DataFrame:
    """Network, prefix and organisation of addresses from pipe-separated answers (ip, origin, network)."""
    part = lambda c, i: trimmed(F.get(F.split(F.regexp_replace(c, '^"+|"+$', ""), r"\|"), F.lit(i)))
    asn = part("origin", 0).try_cast("int")
    return answers.select("ip", asn.alias("asn"), part("origin", 1).alias("cidr"), F.when(asn.isNotNull(), part("network", 4)).alias("organization"))
