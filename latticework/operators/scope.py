"""What lies inside a seed's scope, what its sources tell of roots outside it, and the seeds that come from both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.keys import first_non_empty, host_key, org_key, trimmed
from latticework.functions.names import email_host


def in_scope(rows: DataFrame, roots: DataFrame, by: list[str] = ["seed_id"]) -> DataFrame:  # noqa: B006
    """Rows whose root is one of their seed's (``roots``: seed_id, root)."""
    return rows.join(roots.select(*by, "root").distinct(), [*by, "root"], "left_semi")


def out_of_scope(rows: DataFrame, roots: DataFrame, by: list[str] = ["seed_id"]) -> DataFrame:  # noqa: B006
    """Rows whose root is none of their seed's."""
    return rows.filter("root is not null and root <> ''").join(roots.select(*by, "root").distinct(), [*by, "root"], "left_anti")


def _tags(tags: Column, more: str) -> Column:
    """Tags in lower case, each once, in order, with one more."""
    low = F.transform(F.concat(F.coalesce(tags, F.array().cast("array<string>")), F.array(F.lit(more))), lambda x: F.lower(trimmed(x)))
    return F.array_distinct(F.filter(low, lambda x: x != ""))


def discovered_seeds(parents: DataFrame, found: DataFrame, tag: str) -> DataFrame:
    """Seeds of roots (parent_id, root) that were found for their parents (id, company_name, address, industry, tags): what the parent has is inherited."""
    p = parents.withColumnRenamed("id", "parent_id")
    rows = found.select("parent_id", "root").filter("root <> ''").distinct().join(p, "parent_id")
    return rows.select(
        F.concat_ws(":", "parent_id", "root").alias("id"), first_non_empty(F.col("company_name"), F.col("parent_id")).alias("company_name"),
        F.array("root").alias("domains"), "address", "industry", _tags(F.col("tags"), tag).alias("tags"),
    )


def followup_hosts(parents: DataFrame, pointers: DataFrame, roots: DataFrame) -> DataFrame:
    """Hosts that addresses point to (seed_id, host, root), inside their seed's scope, as seeds of their own."""
    hosts = in_scope(pointers.withColumn("host", host_key(F.col("host"))).filter("host <> ''"), roots).select("seed_id", "host").distinct()
    rows = hosts.join(parents.withColumnRenamed("id", "seed_id").drop("company_name"), "seed_id")
    name = F.when(F.col("seed_id") == "", F.col("host")).otherwise(F.concat("seed_id", F.lit(":ptr:"), "host"))
    return rows.select(name.alias("id"), F.col("host").alias("company_name"), F.array("host").alias("domains"), "address", "industry", _tags(F.col("tags"), "ptr-recursion").alias("tags"))


def _first(rows: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each group; only so many leave a map task."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter(F.col("_n") <= most).drop("_n")


def sitemap_roots(urls: DataFrame, scope: DataFrame, most_urls: int = 500, most_roots: int = 25, samples: int = 3) -> DataFrame:
    """Per seed the roots outside its scope that its sitemaps name: their documents, and the first URLs.

    ``urls``: seed_id, doc, url, root, pos (a total order of a seed's locations). Only the first ``most_urls`` distinct URLs of a seed count, and of
    these the first ``most_roots`` roots.
    """
    once = urls.groupBy("seed_id", "url").agg(F.min_by(F.struct("doc", "root", "pos"), "pos").alias("x")).select("seed_id", "url", "x.*")
    seen = out_of_scope(_first(once, ["seed_id"], "pos", most_urls), scope)
    told = seen.groupBy("seed_id", "root").agg(F.sort_array(F.collect_list(F.struct("pos", "doc", "url"))).alias("all"), F.min("pos").alias("pos"))
    documents = F.array_distinct(F.transform("all", lambda x: x.doc))
    return _first(told, ["seed_id"], "pos", most_roots).select("seed_id", "root", documents.alias("documents"), F.slice(F.transform("all", lambda x: x.url), 1, samples).alias("samples"))


def hint_roots(hints: DataFrame, known: DataFrame, samples: int = 3) -> DataFrame:
    """Per seed the roots that hints (seed_id, root, href, text, pos) lead to, but for known ones: the distinct hints counted, and the first of them."""
    low = [F.lower(trimmed(F.col(c))).alias(f"_{c}") for c in ("href", "text")]
    once = out_of_scope(hints, known).groupBy("seed_id", "root", *low).agg(F.min(F.struct("pos", "href", "text")).alias("x"))
    counts = once.groupBy("seed_id", "root").agg(F.count("*").alias("hints"))
    top = _first(once.select("seed_id", "root", "x.*"), ["seed_id", "root"], "pos", samples).groupBy("seed_id", "root").agg(F.sort_array(F.collect_list(F.struct("pos", "href", "text"))).alias("all"))
    return counts.join(top, ["seed_id", "root"]).select("seed_id", "root", "hints", F.transform("all", lambda x: F.struct(x.href.alias("href"), x.text.alias("text"))).alias("samples"))


def terms_per_root(found: DataFrame, known: DataFrame, most: int = 25) -> DataFrame:
    """Per seed the roots that searches for its terms gave (seed_id, term, root, pos), but for known ones: the first ``most``, each with its terms in order."""
    rows = out_of_scope(found, known)
    once = rows.groupBy("seed_id", "root", "term").agg(F.min("pos").alias("pos"))
    told = once.groupBy("seed_id", "root").agg(F.min("pos").alias("pos"), F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("all"))
    return _first(told, ["seed_id"], "pos", most).select("seed_id", "root", F.transform("all", lambda x: x.term).alias("terms"))


#: Which set of a seed's baseline the roots of a record kind belong to.
BASELINE = {"NS": "ns_roots", "MX": "mail_roots", "TXT": "txt_roots", "CNAME": "cname_roots"}


def seed_baseline(scope: DataFrame, records: DataFrame, registrations: DataFrame) -> DataFrame:
    """Per seed what its own domains show: sets of roots, addresses, roots by record kind, registrants and roots of their mail.

    ``scope``: seed_id, root. ``records``: seed_id, type, value, root (of the host in it). ``registrations``: seed_id, registrant_org, registrant_email, email_root, name_server_roots.
    """
    told = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    kind = F.upper("type")
    of_record = F.when(kind.isin("A", "AAAA"), told("ips", F.lower(trimmed(F.col("value")))))
    for name, target in BASELINE.items():
        of_record = of_record.when(kind == name, told(target, F.col("root")))
    email = F.when(email_host(F.col("registrant_email")).isNotNull(), F.col("email_root"))
    of_registration = F.concat(F.array(told("orgs", org_key(F.col("registrant_org"))), told("email_roots", email)), F.transform(F.coalesce("name_server_roots", F.array().cast("array<string>")), lambda r: told("ns_roots", r)))
    rows = scope.select("seed_id", told("roots", F.col("root")).alias("x")).union(records.select("seed_id", of_record.alias("x"))).union(registrations.select("seed_id", F.explode(of_registration)))
    rows = rows.select("seed_id", "x.*").filter("value is not null and value <> ''").distinct()
    names = ["roots", "ips", *BASELINE.values(), "orgs", "email_roots"]
    return rows.groupBy("seed_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == n, F.col("value")))).alias(n) for n in names))


def crawl_evidence(roots: DataFrame) -> DataFrame:
    """Evidence lines (kind, summary) of roots that crawled pages link to (links, referrers, relations, samples: arrays in order)."""
    relations = F.array_sort(F.filter("relations", lambda x: (x != "") & (x != "anchor")))
    context = F.when(F.size(relations) > 0, F.concat(F.lit("Linked from first-party page contexts tagged as: "), F.array_join(relations, ", ")))
    told = F.format_string("Observed %d outbound link(s) from %d crawled page(s)", "links", "referrers")
    return _lines(roots, [("crawl_link_summary", told), ("crawl_first_party_context", context), ("crawl_link_samples", F.when(F.size("samples") > 0, F.concat(F.lit("Sample crawl edges: "), F.array_join(F.slice("samples", 1, 3), " ; "))))])


def sitemap_evidence(roots: DataFrame) -> DataFrame:
    """Evidence lines (kind, summary) of roots that sitemaps name (documents, samples)."""
    told = lambda c, text: F.when(F.size(c) > 0, F.concat(F.lit(text), F.array_join(c, ", ")))
    return _lines(roots, [("sitemap_document", told("documents", "Referenced in sitemap document(s): ")), ("sitemap_page_samples", told("samples", "Sample sitemap URLs under this root: "))])


def _lines(roots: DataFrame, lines: list[tuple[str, Column]]) -> DataFrame:
    items = F.array_compact(F.array(*(F.when(text.isNotNull(), F.struct(F.lit(kind).alias("kind"), text.alias("summary"))) for kind, text in lines)))
    return roots.select("seed_id", "root", F.posexplode(items).alias("position", "x")).select("seed_id", "root", "position", "x.*")


def seed_context(known: DataFrame, outcomes: DataFrame, most: int = 12) -> DataFrame:
    """Per seed a bounded summary: known, accepted and discarded roots, the first ``most`` of each in order, and how many there are."""
    roots = known.select("seed_id", "root", F.lit("known").alias("kind")).union(outcomes.select("seed_id", "root", F.when(F.col("collect"), "accepted").otherwise("discarded"))).distinct()
    counts = roots.groupBy("seed_id").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("known", "accepted", "discarded")))
    top = _first(roots, ["seed_id", "kind"], "root", most).groupBy("seed_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("root")))).alias(k) for k in ("known", "accepted", "discarded")))
    return counts.join(top, "seed_id")


def observations_of(sources: list[DataFrame]) -> DataFrame:
    """One table of sightings from what the sources found (type, identifier, source, enumeration_id, and what else each has), identifiers in normal form, empty ones gone."""
    out = sources[0]
    for rows in sources[1:]:
        out = out.unionByName(rows, allowMissingColumns=True)
    return out.withColumn("identifier", host_key(F.col("identifier"))).withColumn("source", trimmed(F.col("source"))).filter("identifier <> ''")


#: Text columns of sightings and edges by the form they take.
TRIMMED = ["id", "asset_id", "enumeration_id", "observation_id", "from_asset_id", "to_asset_id", "label", "reason", "inclusion_reason"]
LOWERED = ["identifier", "from_identifier", "to_identifier", "source", "ownership_state"]


def normalized(rows: DataFrame) -> DataFrame:
    """Sightings or edges with their text columns in normal form; a sighting's kind is enrichment or else discovery."""
    form = {c: trimmed(F.col(c)) for c in TRIMMED if c in rows.columns} | {c: F.lower(trimmed(F.col(c))) for c in LOWERED if c in rows.columns}
    if "kind" in rows.columns:
        kind = F.lower(trimmed(F.col("kind")))
        form["kind"] = F.when(kind == "enrichment", kind).otherwise("discovery") if "identifier" in rows.columns else kind
    return rows.withColumns(form)


def beyond_first_hit(candidates: DataFrame) -> DataFrame:
    """Candidates with more evidence (an array) than the hit that made them candidates."""
    return candidates.filter(F.size("evidence") > 1)


def sorted_limit(values: Column, most: int) -> Column:
    """The first ``most`` values of an array in order."""
    return F.slice(F.array_sort(values), 1, most)


def promoted_observations(decisions: DataFrame, facts: DataFrame, source: str) -> DataFrame:
    """Sightings of roots whose promotion was accepted (enumeration_id, root, decision), with what is known of them (root, and any more columns); others give none."""
    rows = decisions.filter("decision = 'accepted'").join(facts, "root", "left").withColumnRenamed("root", "identifier")
    return rows.drop("decision").withColumns({"type": F.lit("domain"), "source": F.lit(source)})
