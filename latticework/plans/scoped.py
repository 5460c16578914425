"""Registered queries over scopes, roots outside them, baselines and evidence. Seeds are suppliers; what is found for them comes from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.functions import keys
from latticework.operators import details, graph, scope, windows

from . import adapters as ad
from .adapters import OBSERVATIONS, OUTCOMES, table
from .collected import _f
from .queries import query

#: Each line item shows its supplier's seed a host; a seed's own roots are three of the fifty.
FOUND = """fd as (select concat('seed-', l_suppkey) as seed_id, concat('h', l_linenumber, '.org', l_partkey % 50, '.com') as host, concat('org', l_partkey % 50, '.com') as root, l_orderkey * 10 + l_linenumber as n, l_partkey * 1000000 + l_orderkey * 10 + l_linenumber as pos, l_linenumber, l_partkey from lineitem),
sr as (select concat('seed-', s_suppkey) as seed_id, concat('org', (s_suppkey + k) % 50, '.com') as root from supplier, unnest([0, 1, 2]) as u(k))"""


def _found(spark, sf_dir):
    n = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(_f("seed-%d", "l_suppkey").alias("seed_id"), F.concat(_f("h%d.org", "l_linenumber"), (F.col("l_partkey") % 50).cast("string"), F.lit(".com")).alias("host"), F.concat(F.lit("org"), (F.col("l_partkey") % 50).cast("string"), F.lit(".com")).alias("root"), n.alias("n"), (F.col("l_partkey") * 1_000_000 + n).alias("pos"), "l_linenumber", "l_partkey")


def _roots(spark, sf_dir):
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    return table(spark, sf_dir, "supplier").select("s_suppkey", k.alias("k")).select(_f("seed-%d", "s_suppkey").alias("seed_id"), F.concat(F.lit("org"), ((F.col("s_suppkey") + F.col("k")) % 50).cast("string"), F.lit(".com")).alias("root"))


def _parents(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(_f("seed-%d", "s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise(F.col("s_name")).alias("company_name"), F.concat(F.lit("Street "), ad.text("s_nationkey")).alias("address"), F.lit("trade").alias("industry"), F.array(F.lit("East "), F.concat(F.lit("n"), ad.text("s_nationkey"))).alias("tags"))


PARENTS = "pa as (select concat('seed-', s_suppkey) as id, case when s_suppkey % 3 = 0 then concat('seed-', s_suppkey) else s_name end as company_name, concat('Street ', s_nationkey) as address, 'trade' as industry, concat('east,n', s_nationkey) as tags from supplier)"


@query(f"with {FOUND} select seed_id, host, count(*) as seen from fd where (seed_id, root) in (select seed_id, root from sr) group by 1, 2")
def in_scope(spark, sf_dir):
    """Hosts found inside their seed's scope."""
    return scope.in_scope(_found(spark, sf_dir), _roots(spark, sf_dir)).groupBy("seed_id", "host").agg(F.count("*").alias("seen"))


def _seed_rows(rows):
    return rows.select("id", "company_name", F.array_join("domains", ",").alias("domains"), "address", "industry", F.array_join("tags", ",").alias("tags"))


@query(f"with {FOUND}, {PARENTS} select distinct concat(seed_id, ':ptr:', host) as id, host as company_name, host as domains, address, industry, concat(tags, ',ptr-recursion') as tags from fd join pa on pa.id = seed_id where (seed_id, root) in (select seed_id, root from sr)")
def followup_hosts(spark, sf_dir):
    """Hosts that addresses point to inside the scope, as seeds."""
    pointers = _found(spark, sf_dir).withColumn("host", F.concat(F.upper("host"), F.lit(".")))
    return _seed_rows(scope.followup_hosts(_parents(spark, sf_dir), pointers, _roots(spark, sf_dir)))


@query(f"with {FOUND}, {PARENTS} select distinct concat(seed_id, ':', root) as id, company_name, root as domains, address, industry, concat(tags, ',crawl') as tags from fd join pa on pa.id = seed_id where (seed_id, root) not in (select seed_id, root from sr)")
def discovered_seeds(spark, sf_dir):
    """Roots found outside the scope, as seeds that inherit from their parents."""
    found = scope.out_of_scope(_found(spark, sf_dir), _roots(spark, sf_dir)).select(F.col("seed_id").alias("parent_id"), "root")
    return _seed_rows(scope.discovered_seeds(_parents(spark, sf_dir), found, "Crawl"))


SITEMAP_ROOTS = f"""{FOUND}, ur as (select seed_id, concat('https://', host, '/', l_partkey) as url, arg_min(concat('d', l_linenumber), pos) as doc, arg_min(root, pos) as root, min(pos) as pos from fd group by 1, 2),
 fu as (select *, row_number() over (partition by seed_id order by pos) as r from ur), ou as (select * from fu where r <= 500 and (seed_id, root) not in (select seed_id, root from sr)),
 ro as (select seed_id, root, min(pos) as first from ou group by 1, 2), ra as (select *, row_number() over (partition by seed_id order by first) as r from ro),
 dc as (select seed_id, root, doc, min(pos) as pos from ou group by 1, 2, 3), ds as (select seed_id, root, string_agg(doc, ', ' order by pos) as documents from dc group by 1, 2),
 sm as (select seed_id, root, string_agg(url, ', ' order by pos) as samples from (select *, row_number() over (partition by seed_id, root order by pos) as n from ou) where n <= 3 group by 1, 2),
 st as (select ra.seed_id, ra.root, documents, samples from ra join ds on ds.seed_id = ra.seed_id and ds.root = ra.root join sm on sm.seed_id = ra.seed_id and sm.root = ra.root where ra.r <= 25)"""


def _sitemap_roots(spark, sf_dir):
    urls = _found(spark, sf_dir).select("seed_id", _f("d%d", "l_linenumber").alias("doc"), F.concat(F.lit("https://"), "host", F.lit("/"), ad.text("l_partkey")).alias("url"), "root", "pos")
    return scope.sitemap_roots(urls, _roots(spark, sf_dir))


@query(f"with {SITEMAP_ROOTS} select * from st")
def sitemap_roots(spark, sf_dir):
    """Roots outside the scope that sitemaps name."""
    return _sitemap_roots(spark, sf_dir).select("seed_id", "root", F.array_join("documents", ", ").alias("documents"), F.array_join("samples", ", ").alias("samples"))


@query(f"""with {SITEMAP_ROOTS} select seed_id, root, 0 as position, 'sitemap_document' as kind, concat('Referenced in sitemap document(s): ', documents) as summary from st
 union all select seed_id, root, 1, 'sitemap_page_samples', concat('Sample sitemap URLs under this root: ', samples) from st""")
def sitemap_evidence(spark, sf_dir):
    """Evidence lines of roots that sitemaps name."""
    return scope.sitemap_evidence(_sitemap_roots(spark, sf_dir))


@query(f"""with {FOUND}, h as (select seed_id, root, concat('https://', host, '/') as href, case when l_linenumber % 2 = 0 then 'Group' else 'canonical' end as text, pos from fd where (seed_id, root) not in (select seed_id, root from sr)),
 o as (select seed_id, root, href, text, min(pos) as pos from h group by all), r as (select *, row_number() over (partition by seed_id, root order by pos) as n, count(*) over (partition by seed_id, root) as hints from o)
 select seed_id, root, hints, string_agg(concat(href, ' ', text), ', ' order by pos) as samples from r where n <= 3 group by 1, 2, 3""")
def hint_roots(spark, sf_dir):
    """Roots outside the scope that hints lead to."""
    hints = _found(spark, sf_dir).select("seed_id", "root", F.concat(F.lit("https://"), "host", F.lit("/")).alias("href"), F.when(F.col("l_linenumber") % 2 == 0, "Group").otherwise("canonical").alias("text"), "pos")
    rows = scope.hint_roots(hints, _roots(spark, sf_dir))
    return rows.select("seed_id", "root", "hints", F.array_join(F.transform("samples", lambda x: F.concat(x.href, F.lit(" "), x.text)), ", ").alias("samples"))


@query(f"""with {FOUND}, o as (select seed_id, root, concat('t', l_linenumber) as term, min(pos) as pos from fd where (seed_id, root) not in (select seed_id, root from sr) group by 1, 2, 3),
 r as (select seed_id, root, min(pos) as pos, string_agg(term, ',' order by pos) as terms from o group by 1, 2) select seed_id, root, terms from (select *, row_number() over (partition by seed_id order by pos) as n from r) where n <= 25""")
def ct_terms_per_root(spark, sf_dir):
    """Terms whose searches gave each root outside the scope."""
    found = _found(spark, sf_dir).select("seed_id", "root", _f("t%d", "l_linenumber").alias("term"), "pos")
    return scope.terms_per_root(found, _roots(spark, sf_dir)).select("seed_id", "root", F.array_join("terms", ",").alias("terms"))


_SET = lambda t, v: f"coalesce(string_agg(distinct {v}, ',' order by {v}) filter (where kind = '{t}'), '')"


@query(f"""with {FOUND}, x as (select seed_id, 'roots' as kind, root as v from sr union all select seed_id, case l_linenumber % 6 when 0 then 'ips' when 1 then 'ips' when 2 then 'ns_roots' when 3 then 'mail_roots' when 4 then 'txt_roots' else 'cname_roots' end,
  case when l_linenumber % 6 < 2 then concat('10.0.0.', l_partkey % 20) else root end from fd union all select concat('seed-', s_suppkey), 'orgs', concat('supplier ', s_nationkey, ' inc') from supplier union all select concat('seed-', s_suppkey), 'email_roots', 'mail.com' from supplier where s_suppkey % 2 = 0
  union all select concat('seed-', s_suppkey), 'ns_roots', concat('ns', s_nationkey, '.net') from supplier)
 select seed_id, {', '.join(f"{_SET(t, 'v')} as {t}" for t in ('roots', 'ips', 'ns_roots', 'mail_roots', 'txt_roots', 'cname_roots', 'orgs', 'email_roots'))} from x group by 1""")
def seed_baseline(spark, sf_dir):
    """What each seed's own domains show."""
    n = F.col("l_linenumber") % 6
    kind = F.when(n == 0, "a").when(n == 1, "AAAA").when(n == 2, "NS").when(n == 3, "mx").when(n == 4, "TXT").otherwise("CNAME")
    records = _found(spark, sf_dir).select("seed_id", kind.alias("type"), F.concat(F.lit("10.0.0."), (F.col("l_partkey") % 20).cast("string")).alias("value"), "root")
    registered = table(spark, sf_dir, "supplier").select(_f("seed-%d", "s_suppkey").alias("seed_id"), _f("Supplier #%d, Inc.", "s_nationkey").alias("registrant_org"), F.when(F.col("s_suppkey") % 2 == 0, "a@x.mail.com").otherwise("none").alias("registrant_email"), F.lit("mail.com").alias("email_root"), F.array(_f("ns%d.net", "s_nationkey")).alias("name_server_roots"))
    rows = scope.seed_baseline(_roots(spark, sf_dir), records, registered)
    return rows.select("seed_id", *(F.array_join(c, ",").alias(c) for c in rows.columns[1:]))


@query(f"""with {FOUND}, l as (select seed_id, root, host as referrer, case l_linenumber % 3 when 0 then 'about' when 1 then 'anchor' else 'legal' end as relation, concat('s', l_linenumber) as sample, pos from fd where (seed_id, root) not in (select seed_id, root from sr)),
 g as (select seed_id, root, count(*) as links, count(distinct referrer) as referrers, string_agg(distinct relation, ', ' order by relation) filter (where relation <> 'anchor') as relations from l group by 1, 2),
 s as (select seed_id, root, sample, min(pos) as pos from l group by 1, 2, 3), t as (select seed_id, root, string_agg(sample, ' ; ' order by pos) as samples from (select *, row_number() over (partition by seed_id, root order by pos, sample) as n from s) where n <= 3 group by 1, 2)
 select g.seed_id, g.root, u.kind, u.summary from g join t on t.seed_id = g.seed_id and t.root = g.root, unnest([{{'kind': 'crawl_link_summary', 'summary': concat('Observed ', links, ' outbound link(s) from ', referrers, ' crawled page(s)')}},
  {{'kind': 'crawl_first_party_context', 'summary': case when relations is not null then concat('Linked from first-party page contexts tagged as: ', relations) end}}, {{'kind': 'crawl_link_samples', 'summary': concat('Sample crawl edges: ', samples)}}]) as v(u) where u.summary is not null""")
def crawl_evidence(spark, sf_dir):
    """Evidence lines of roots that crawled pages link to."""
    n = F.col("l_linenumber") % 3
    links = scope.out_of_scope(_found(spark, sf_dir), _roots(spark, sf_dir)).select("seed_id", "root", F.col("host").alias("referrer"), F.when(n == 0, "about").when(n == 1, "anchor").otherwise("legal").alias("relation"), _f("s%d", "l_linenumber").alias("sample"), F.col("pos").alias("seq"))
    relations = links.groupBy("seed_id", "root").agg(F.collect_set("relation").alias("relations"))
    roots = details.outbound_roots(links, 3).join(relations, ["seed_id", "root"]).withColumn("samples", F.split("samples", ","))
    return scope.crawl_evidence(roots).drop("position")


@query(f"""with {OUTCOMES}, k as (select distinct concat('seed-', c_custkey % 25) as seed_id, concat('root', c_custkey % 97, '.com') as root, 'known' as kind from customer),
 x as (select * from k union select seed_id, root, case when collect then 'accepted' else 'discarded' end from oc), r as (select *, row_number() over (partition by seed_id, kind order by root) as n, count(*) over (partition by seed_id, kind) as c from x)
 select seed_id, {', '.join(f"coalesce(max(c) filter (where kind = '{k}'), 0) as n_{k}, coalesce(string_agg(root, ',' order by root) filter (where kind = '{k}' and n <= 12), '') as {k}" for k in ('known', 'accepted', 'discarded'))} from r group by 1""")
def seed_context(spark, sf_dir):
    """A bounded summary of each seed's roots."""
    c = F.col("c_custkey")
    known = table(spark, sf_dir, "customer").select(F.concat(F.lit("seed-"), (c % 25).cast("string")).alias("seed_id"), F.concat(F.lit("root"), (c % 97).cast("string"), F.lit(".com")).alias("root"))
    rows = scope.seed_context(known, ad.outcomes(spark, sf_dir))
    return rows.select("seed_id", *(x for k in ("known", "accepted", "discarded") for x in (f"n_{k}", F.array_join(k, ",").alias(k))))


@query("select concat('10.', l_partkey % 256, '.0.', l_linenumber) as ip, concat('10.', l_partkey % 256, '.0.0/16') as cidr from lineitem where l_partkey % 256 < 128 union select concat('2001:db8:', lower(to_hex(l_partkey % 4096)), '::', l_linenumber), concat('2001:DB8:', lower(to_hex(l_partkey % 4096)), '::/48') from lineitem where l_partkey % 4096 < 2048")
def addresses_in_prefixes(spark, sf_dir):
    """Addresses of both kinds, and the prefixes that hold them."""
    lines, p = table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    hexed = F.lower(F.hex(p % 4096))
    ips = lines.select(F.explode(F.array(F.concat(F.lit("10."), (p % 256).cast("string"), F.lit(".0."), ad.text("l_linenumber")), F.concat(F.lit("2001:db8:"), hexed, F.lit("::"), ad.text("l_linenumber")), F.lit("no address"))).alias("ip"))
    some = F.array(F.when(p % 256 < 128, F.concat(F.lit("10."), (p % 256).cast("string"), F.lit(".0.0/16"))), F.when(p % 4096 < 2048, F.concat(F.lit("2001:DB8:"), hexed, F.lit("::/48"))), F.lit("10.0.0.0/99"), F.lit("x/8"))
    return graph.addresses_in_prefixes(ips, lines.select(F.explode(F.array_compact(some)).alias("cidr")))


@query("select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as position from orders")
def pivot_order(spark, sf_dir):
    """Candidates under review in order of creation."""
    return windows.positions(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "position")


@query(f"with {OUTCOMES}, g as (select distinct collector, seed_id, scenario from oc) select *, row_number() over (order by collector, seed_id, scenario) as position from g")
def summary_order(spark, sf_dir):
    """Groups of decisions in the order of their summary."""
    return windows.positions(ad.outcomes(spark, sf_dir).select("collector", "seed_id", "scenario").distinct(), ["collector", "seed_id", "scenario"])


@query("select 'domain' as type, concat('h', l_partkey, '.com') as identifier, 'crawler_collector' as source, cast(l_orderkey as varchar) as enumeration_id, null as asn from lineitem union all select 'ip', concat('10.0.0.', s_suppkey % 256), 'asn_cidr_collector', cast(s_suppkey as varchar), s_nationkey::int from supplier")
def union_collectors(spark, sf_dir):
    """Sightings of several sources in one table."""
    crawled = table(spark, sf_dir, "lineitem").select(F.lit("domain").alias("type"), _f("H%d.com.", "l_partkey").alias("identifier"), F.lit(" crawler_collector").alias("source"), ad.text("l_orderkey").alias("enumeration_id"))
    dealt = table(spark, sf_dir, "supplier").select(F.lit("ip").alias("type"), F.concat(F.lit("10.0.0."), (F.col("s_suppkey") % 256).cast("string")).alias("identifier"), F.lit("asn_cidr_collector").alias("source"), ad.text("s_suppkey").alias("enumeration_id"), F.col("s_nationkey").cast("int").alias("asn"))
    return scope.observations_of([crawled, dealt])


@query("select 'domain' as type, concat('root', l_partkey, '.com') as identifier, 'dns_collector' as source, cast(l_orderkey as varchar) as enumeration_id, p_name as registrant from lineitem left join part on p_partkey = l_partkey where l_returnflag = 'A'")
def promoted_observations(spark, sf_dir):
    """Sightings of accepted roots with what is known of them."""
    root = lambda c: F.concat(F.lit("root"), ad.text(c), F.lit(".com"))
    flag = F.col("l_returnflag")
    decisions = table(spark, sf_dir, "lineitem").select(ad.text("l_orderkey").alias("enumeration_id"), root("l_partkey").alias("root"), F.when(flag == "A", "accepted").when(flag == "R", "rejected").otherwise("pending").alias("decision"))
    return scope.promoted_observations(decisions, table(spark, sf_dir, "part").select(root("p_partkey").alias("root"), F.col("p_name").alias("registrant")), "dns_collector")


@query(f"with {OBSERVATIONS}, p as (select distinct type, asset_key, id as asset_id, enumeration_id, source, case when seq % 10 = 0 then null else seen_us end as seen_us from o) select type, asset_key, count(*) as sightings, string_agg(concat(asset_id, '|', enumeration_id, '|', source), ',' order by seen_us is null, seen_us, concat(asset_id, '|', enumeration_id, '|', source)) as provenance from p group by 1, 2")
def provenance_order(spark, sf_dir):
    """Sightings of each asset in order of date, those without one last."""
    obs = ad.observations(spark, sf_dir).select("type", keys.asset_key(F.col("identifier")).alias("asset_key"), F.col("id").alias("asset_id"), "enumeration_id", "source", F.when(F.col("seq") % 10 != 0, F.col("seen_us")).alias("seen_us"))
    rows = graph.provenance(obs)
    return rows.select("type", "asset_key", F.size("provenance").cast("bigint").alias("sightings"), F.array_join(F.transform("provenance", lambda x: F.concat_ws("|", x.asset_id, x.enumeration_id, x.source)), ",").alias("provenance"))


@query("select min(concat('rel-', l_orderkey, '-', l_linenumber)) as id, concat('part-', l_partkey % 50) as from_identifier, concat('supp-', l_suppkey) as to_identifier, l_returnflag as kind, l_linestatus as label from lineitem group by 2, 3, 4, 5")
def distinct_edges(spark, sf_dir):
    """Edges of equal content once."""
    rel = table(spark, sf_dir, "lineitem").select(_f("rel-%d-%d", "l_orderkey", "l_linenumber").alias("id"), F.concat(F.lit("part-"), (F.col("l_partkey") % 50).cast("string")).alias("from_identifier"), _f("supp-%d", "l_suppkey").alias("to_identifier"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("label"))
    return graph.distinct_edges(rel)


@query("select concat('o', l_orderkey, '-', l_linenumber) as id, case when l_linenumber % 4 = 0 then 'without' else 'unknown' end as issue from lineitem where l_linenumber % 4 = 0 or l_suppkey % 2 = 1 or l_suppkey not in (select s_suppkey from supplier)")
def stray_observations(spark, sf_dir):
    """Sightings whose asset is missing."""
    s = F.col("l_suppkey")
    asset = F.when(F.col("l_linenumber") % 4 == 0, "").when(s % 2 == 1, F.concat(F.lit("gone-"), s.cast("string"))).otherwise(F.concat(F.lit("A-"), s.cast("string")))
    obs = table(spark, sf_dir, "lineitem").select(_f("o%d-%d", "l_orderkey", "l_linenumber").alias("id"), asset.alias("asset_id"))
    return graph.stray_observations(obs, table(spark, sf_dir, "supplier").select(_f("A-%d", "s_suppkey").alias("asset_id")))
