"""Joins that enrich assets: contributors, captured records and registrations, ownership of addresses, overlap with a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.keys import ip4_number, trimmed, truncated
from latticework.operators.graph import addresses_in_prefixes
from latticework.session import spread, stored

#: Roots that many owners share, never candidates.
SHARED_ROOTS = [
    "akamai.net", "amazonaws.com", "apple.com", "atlassian.net", "azure.com", "cloudflare.com", "facebook.com", "github.com", "github.io", "gitlab.com", "google.com", "googleapis.com", "hubspot.com",
    "instagram.com", "linkedin.com", "microsoft.com", "myshopify.com", "office.com", "okta.com", "salesforce.com", "shopify.com", "slack.com", "whatsapp.com", "x.com", "youtube.com", "zendesk.com",
]
#: Suffixes tried for any label.
GENERIC_SUFFIXES = ["com", "net", "org", "io", "co", "app", "dev", "ai", "cloud", "tech"]
#: Record types whose targets are hosts, and the kind of edge each gives.
RECORD_KINDS = {"A": "dns_a", "AAAA": "dns_aaaa", "MX": "dns_mx", "NS": "dns_ns", "TXT": "dns_txt", "CNAME": "dns_cname"}


def contributors(provenance: DataFrame, enumerations: DataFrame, seeds: DataFrame) -> DataFrame:
    """Provenance (…, enumeration_id) with its seed and label: the company, else the seed's id. Rows without either stay."""
    rows = provenance.join(enumerations.select(F.col("id").alias("enumeration_id"), "seed_id"), "enumeration_id", "left")
    rows = rows.join(seeds.select(F.col("id").alias("seed_id"), "company_name"), "seed_id", "left")
    return rows.withColumn("label", F.coalesce(F.nullif(F.trim("company_name"), F.lit("")), "seed_id", F.lit(""))).drop("company_name")


def seed_contributions(contributed: DataFrame, by: list[str]) -> DataFrame:
    """Per asset and label: contributions, enumerations, sources, first and last sight."""
    names = F.array_join(F.array_sort(F.collect_set("source")), ", ")
    return contributed.groupBy(*by, "label").agg(F.count("*").alias("contributions"), F.count_distinct("enumeration_id").alias("enumerations"), names.alias("sources"), F.min("seen_us").alias("first_us"), F.max("seen_us").alias("last_us"))


def relation_kind(record_type: Column) -> Column:
    """The kind of edge that a record gives; null for other types."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in RECORD_KINDS.items() for x in kv)), F.upper(record_type))


def host_edges(records: DataFrame, scope: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (seed_id, domain, record_type, host, root) split by whether the seed's scope (seed_id, root) holds the root: edges, candidates."""
    known = scope.select("seed_id", "root").distinct()
    edges = records.join(known, ["seed_id", "root"], "left_semi").select("seed_id", "domain", "host", relation_kind(F.col("record_type")).alias("kind")).distinct()
    return edges, records.join(known, ["seed_id", "root"], "left_anti").select("seed_id", "root", "host", "record_type").distinct()


def needs_enrichment(stage: Column) -> Column:
    return F.coalesce(stage, F.lit("")).isin("", "missing", "retryable")


def enrich_domains(domains: DataFrame, records: DataFrame, registrations: DataFrame) -> DataFrame:
    """Domains (domain, root, stage) with records and, for registrable names, their registration; looked up only where the stage asks for it."""
    one = records.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", F.upper("record_type"), F.lower("value")))), ", ").alias("records"))
    rows = domains.join(one, "domain", "left").join(registrations.select("domain", "registrant_org"), "domain", "left")
    ask = needs_enrichment(F.col("stage"))
    done = F.when(~ask, "cached").when(F.col("records").isNotNull(), "completed").otherwise("retryable")
    return rows.select("domain", F.when(ask, F.col("records")).alias("records"), F.when(ask & (F.col("domain") == F.col("root")), F.col("registrant_org")).alias("registrant_org"), done.alias("stage"))


def enrich_ips(ips: DataFrame, pointers: DataFrame, origins: DataFrame) -> DataFrame:
    """Addresses (ip, stage) with what captured lookups tell, looked up only where the stage asks for it.

    ``pointers`` (ip, ptr, pos): the first name counts, without its last dot. ``origins`` (cidr, asn, organization): that of the longest prefix that holds the address, of
    equally long ones the smallest cidr. Gives ptr, asn, organization, cidr, and the stage: cached where nothing was asked, completed where any lookup had an
    answer, else retryable. What is no address is in no prefix.
    """
    ask = needs_enrichment(F.col("stage"))
    names = pointers.groupBy("ip").agg(F.regexp_replace(F.min_by("ptr", "pos"), r"\.$", "").alias("ptr"))
    length = F.try_element_at(F.split("cidr", "/"), F.lit(2)).try_cast("int")
    inside = addresses_in_prefixes(ips.filter(ask).select("ip"), origins.select("cidr"))
    best = inside.groupBy("ip").agg(F.min_by("cidr", F.struct(-length, "cidr")).alias("cidr"))
    origin = origins.groupBy("cidr").agg(F.min(F.struct("asn", "organization")).alias("o"))
    rows = ips.join(names, "ip", "left").join(best.join(origin, "cidr"), "ip", "left")
    shown = lambda c, out: F.when(ask, F.col(c)).alias(out)
    done = F.when(~ask, "cached").when(F.col("ptr").isNotNull() | F.col("o").isNotNull(), "completed").otherwise("retryable")
    return rows.select("ip", shown("ptr", "ptr"), shown("o.asn", "asn"), shown("o.organization", "organization"), shown("cidr", "cidr"), done.alias("stage"))


def ip_ownership(ips: DataFrame, contributed: DataFrame, seed_roots: DataFrame, seed_asns: DataFrame, seed_prefixes: DataFrame) -> DataFrame:
    """Ownership of addresses (ip, ptr, ptr_root, asn) by the seeds that contributed them (ip, seed_id).

    Owned where the PTR root, the network or a prefix (seed_id, cidr, base, len) is that of a contributing seed; else
    uncertain where the PTR has a root; else associated. Prefixes are joined by equality of seed, length and masked key, so an address meets the prefixes of its own seeds only.
    """
    c = contributed.select("ip", "seed_id").filter("seed_id is not null").distinct()
    with_seed = ips.join(c, "ip")
    hits = with_seed.join(seed_roots.select("seed_id", F.col("root").alias("ptr_root")).distinct(), ["seed_id", "ptr_root"], "left_semi").select("ip")
    hits = hits.union(with_seed.join(seed_asns.select("seed_id", "asn").distinct(), ["seed_id", "asn"], "left_semi").select("ip"))
    lens = seed_prefixes.select("len").distinct().agg(F.collect_list("len").alias("lens"))  # 33 lengths at most
    heads = c.withColumn("n", ip4_number(F.col("ip"))).filter("n is not null").join(F.broadcast(lens)).select("ip", "seed_id", "n", F.explode("lens").alias("len"))
    heads = heads.withColumn("base", F.expr("n - n % shiftleft(1L, 32 - len)"))
    hits = hits.union(heads.join(seed_prefixes.select("seed_id", "len", "base"), ["seed_id", "len", "base"], "left_semi").select("ip"))
    rows = ips.join(hits.distinct().withColumn("hit", F.lit(True)), "ip", "left").join(c.select("ip").distinct().withColumn("seeded", F.lit(True)), "ip", "left")
    state = F.when(F.col("seeded").isNull(), "associated_infrastructure").when(F.col("hit"), "owned").when(F.coalesce("ptr_root", F.lit("")) != "", "uncertain").otherwise("associated_infrastructure")
    reason = (
        F.when(F.col("seeded").isNull(), "").when(F.col("hit"), "Corroborated by PTR/ASN/CIDR overlap with an in-scope seed")
        .when(state == "uncertain", F.concat(F.lit("Observed behind an in-scope domain, but PTR points to "), F.col("ptr"))).otherwise("Observed as infrastructure supporting an in-scope domain")
    )
    return rows.select("ip", state.alias("ownership_state"), reason.alias("reason"))


def set_overlap(facts: DataFrame, baseline: DataFrame, kinds: list[str]) -> DataFrame:
    """Per candidate (seed_id, root) the values of each kind that the seed's baseline (seed_id, kind, value) has too; corroborated if there is any."""
    by = ["seed_id", "root"]
    hit = facts.select(*by, "kind", "value").distinct().join(baseline.select("seed_id", "kind", "value").distinct().withColumn("hit", F.lit(True)), ["seed_id", "kind", "value"], "left")
    lists = [F.array_join(F.array_sort(F.collect_set(F.when(F.col("hit") & (F.col("kind") == k), F.col("value")))), ",").alias(k) for k in kinds]
    return hit.groupBy(*by).agg(*lists, F.coalesce(F.bool_or(F.col("hit") & F.col("kind").isin(kinds)), F.lit(False)).alias("corroborated"))


def anti_known(candidates: DataFrame, of_seed: DataFrame, everywhere: DataFrame, shared: list[str] = SHARED_ROOTS) -> DataFrame:
    """Candidates (seed_id, root) that neither their seed, nor all of them, nor the list of shared roots excludes."""
    rows = candidates.filter(~F.col("root").isin(shared)).join(of_seed, ["seed_id", "root"], "left_anti")
    return rows.join(everywhere, "root", "left_anti")


def resolve_parent(evaluations: DataFrame, seeds: DataFrame) -> DataFrame:
    """Evaluations (seed_id, domain_key, label) with the seed they mean: by id, else by domains, else by label; of equal seeds the last counts."""
    last = lambda c, out: seeds.filter(F.coalesce(F.col(c), F.lit("")) != "").groupBy(F.col(c).alias(f"k_{c}")).agg(F.max_by("id", "seq").alias(out))
    rows = evaluations
    for c, own in (("id", "seed_id"), ("domain_key", "domain_key"), ("company_name", "label")):
        key = F.lower(F.trim(F.col(own))) if c == "company_name" else F.trim(F.col(own))
        side = last(c, f"by_{c}") if c != "company_name" else seeds.filter("trim(company_name) <> ''").groupBy(F.lower(F.trim("company_name")).alias("k_company_name")).agg(F.max_by("id", "seq").alias("by_company_name"))
        rows = rows.join(side, key == F.col(f"k_{c}"), "left").drop(f"k_{c}")
    return rows.withColumn("parent_id", F.coalesce("by_id", "by_domain_key", "by_company_name", "seed_id")).drop("by_id", "by_domain_key", "by_company_name")


def variant_roots(labels: DataFrame, suffixes: DataFrame, own: DataFrame, known: DataFrame, most: int | None = None) -> DataFrame:
    """Roots that a seed's labels (seed_id, label) form with other suffixes (suffix, pos), ranked, without those known (root).

    A seed's own suffixes (seed_id, suffix) come first, then those with the same last label, then the generic ones, then the
    rest in list order. Each label is given the whole list, which is the feature; ``most`` cuts the ranks of a seed.
    """
    from pyspark.sql import Window

    last = lambda c: F.substring_index(c, ".", -1)
    mine = own.groupBy("seed_id").agg(F.collect_set("suffix").alias("own"), F.collect_set(last(F.col("suffix"))).alias("family"))
    listed = suffixes.agg(F.sort_array(F.collect_list(F.struct("pos", "suffix"))).alias("all"))  # the suffix list: some thousands of rows
    rows = labels.distinct().join(mine, "seed_id", "left").join(F.broadcast(listed)).select("seed_id", "label", "own", "family", F.explode("all").alias("s"))
    suffix = F.col("s.suffix")
    rank = F.when(F.array_contains("own", suffix), F.lit(0)).when(F.array_contains("family", last(suffix)), 1).when(suffix.isin(GENERIC_SUFFIXES), 2).otherwise(3)
    generic = F.array_position(F.array(*map(F.lit, GENERIC_SUFFIXES)), suffix)
    rows = rows.select("seed_id", F.concat("label", F.lit("."), suffix).alias("root"), rank.alias("priority"), F.when(rank == 2, generic).otherwise(F.col("s.pos")).alias("pos"), "label").join(known, "root", "left_anti")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("seed_id").orderBy("label", "priority", "pos")))
    return (rows.filter(F.col("rank") <= most) if most else rows).select("seed_id", "root", "priority", "rank")


def root_facts(assets: DataFrame) -> DataFrame:
    """Per registrable root what its assets tell. ``assets``: root (of a domain, or of the host that an address points to), kind (domain or ptr), name,
    sources (comma separated), sightings, registrant_org, registrar, name_servers (an array).

    Assets are the domains; every asset counts as one sighting at least. Of names that differ in case the smallest stands for all.
    """
    def names(c: Column) -> Column:
        low = F.array_sort(F.array_distinct(F.transform(F.filter(F.array_distinct(F.flatten(F.collect_set(c))), lambda x: trimmed(x) != ""), lambda x: F.lower(trimmed(x)))))
        return F.array_join(low, ",")

    domain = F.col("kind") == "domain"
    return assets.filter("root <> ''").groupBy("root").agg(
        F.count_if(domain).alias("assets"), F.sum(F.greatest(F.lit(1), F.coalesce("sightings", F.lit(0)))).alias("sightings"), names(F.when(domain, F.array("name"))).alias("identifiers"), names(F.split("sources", ",")).alias("sources"),
        names(F.when(~domain, F.array("name"))).alias("ptr_hosts"), names(F.array_compact(F.array("registrant_org"))).alias("registrants"), names(F.array_compact(F.array("registrar"))).alias("registrars"), names(F.array_compact("name_servers")).alias("name_servers"),
    )


def assets_of_seed(assets: DataFrame, contributed: DataFrame, seed_roots: DataFrame) -> DataFrame:
    """Assets (asset_key, root) of each seed: by an enumeration that contributed them (asset_key, seed_id), else by the seed's roots."""
    by_enumeration = contributed.filter("seed_id is not null").select("seed_id", "asset_key", F.lit(0).alias("how"))
    by_root = assets.join(seed_roots.select("seed_id", "root").distinct(), "root").select("seed_id", "asset_key", F.lit(1).alias("how"))
    # the pairs are stored before they are dealt by their number: few roots make most of them, and a task that joins one would fold all its pairs
    both = spread(stored(by_enumeration.union(by_root), "pairs"), "seed_id", "asset_key").groupBy("seed_id", "asset_key").agg(F.min("how").alias("how"))
    return both.select("seed_id", "asset_key", F.when(F.col("how") == 0, "enumeration").otherwise("root").alias("via"))


def search_edges(candidates: DataFrame, queries: DataFrame, focus: DataFrame, decisions: DataFrame, longest: int = 320) -> DataFrame:
    """Edges from the root searched for (seed_id, focus) to accepted candidates (seed_id, root, summary), with the first query (seed_id, pos, query) and the summary as reason, at most ``longest`` bytes of it."""
    first = queries.groupBy("seed_id").agg(F.min_by("query", "pos").alias("query"))
    rows = candidates.join(decisions.filter("collect").select("seed_id", "root"), ["seed_id", "root"], "left_semi").join(focus, "seed_id").join(first, "seed_id", "left")
    reason = F.concat_ws(": ", "query", "summary")
    return rows.select("seed_id", F.col("focus").alias("from_identifier"), F.col("root").alias("to_identifier"), F.lit("search_result").alias("kind"), truncated(reason, longest).alias("reason"))


def registration_assets(frontier: DataFrame, registrations: DataFrame) -> DataFrame:
    """Domain sightings (enumeration_id, identifier, registrar_name, created) from registrations of the frontier's domains."""
    return frontier.join(registrations, "domain").select("enumeration_id", F.col("domain").alias("identifier"), F.lit("rdap").alias("source"), "registrar_name", "created", "registrant_org")
