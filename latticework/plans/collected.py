"""Registered queries over captured answers. Bodies are derived from orders and their line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.functions import names
from latticework.session import spread
from latticework.sources import records, registrations

from . import adapters as ad
from .adapters import table
from .queries import ANCHORS, URL_SQL, _rules, query


def _f(pattern: str, *columns: str):
    return F.format_string(pattern, *columns)


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def _per_order(rows, item, name="x"):
    """An array for each order; orders are dealt by the number of lines, so a task's part doesn't grow with the table."""
    return spread(rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), "l_orderkey").groupBy(F.col("l_orderkey").alias("seed_id")).agg(F.collect_list(item).alias(name))


@query("select distinct l_orderkey as seed_id, unnest([concat('host', l_partkey, '.com'), concat('www.org', l_suppkey % 7, '.com'), concat('mail', l_linenumber, '.net')]) as name from lineitem")
def ct_term_names(spark, sf_dir):
    """Names that certificate searches for a term give."""
    r = F.struct(_f("*.Host%d.com", "l_partkey").alias("common_name"), F.concat(F.lit("https://www.org"), (F.col("l_suppkey") % 7).cast("string"), F.lit(".com/x\nadmin@Mail"), ad.text("l_linenumber"), F.lit(".net\n10.0.0.1\nlocalhost")).alias("name_value"))
    return records.ct_term_names(_per_order(_lines(spark, sf_dir), r).select("seed_id", F.to_json("x").alias("body")))


@query("select l_orderkey as seed_id, concat('H', l_partkey, '.org') as host from lineitem where l_linenumber % 5 <> 0")
def passive_dns_hosts(spark, sf_dir):
    """Host names of passive DNS answers."""
    r = F.struct(F.when(F.col("l_linenumber") % 5 == 0, "").otherwise(_f("H%d.org", "l_partkey")).alias("hostname"))
    return records.passive_dns_hosts(_per_order(_lines(spark, sf_dir), r).select("seed_id", F.to_json(F.struct(F.col("x").alias("passive_dns"))).alias("body")))


@query("select distinct l_orderkey as seed_id, concat('10.', l_suppkey % 256, '.0.0/16') as prefix from lineitem")
def announced_prefixes(spark, sf_dir):
    """Prefixes that networks announce."""
    r = F.struct(F.concat(F.lit(" 10."), (F.col("l_suppkey") % 256).cast("string"), F.lit(".0.0/16")).alias("prefix"))
    return records.announced_prefixes(_per_order(_lines(spark, sf_dir), r).select("seed_id", F.to_json(F.struct(F.struct(F.col("x").alias("prefixes")).alias("data"))).alias("body")))


@query("select distinct concat('https://org', l_orderkey, '.com/a/robots.txt') as base, case when l_linenumber % 2 = 0 then concat('https://org', l_orderkey, '.com/maps/', l_partkey, '.xml') else concat('https://org', l_orderkey, '.com/a/P', l_partkey, '.xml') end as url from lineitem")
def robots_sitemaps(spark, sf_dir):
    """Sitemaps that robots files name."""
    line = F.when(F.col("l_linenumber") % 2 == 0, _f("SITEMAP: /x/../maps/%d.xml", "l_partkey")).otherwise(_f("User-agent: *\nSitemap: P%d.xml#top", "l_partkey"))
    rows = _per_order(_lines(spark, sf_dir), line)
    return records.robots_sitemaps(rows.select(_f("https://org%d.com/a/robots.txt", "seed_id").alias("base"), F.array_join("x", "\r\n").alias("body")))


@query("select l_orderkey as seed_id, case when l_linenumber % 3 = 0 then 'contact' else 'policy' end as key, case when l_linenumber % 3 = 0 then concat('mailto:sec@org', l_partkey, '.com') else concat('https://org', l_partkey, '.com/p') end as link from lineitem where l_linenumber % 3 <> 1")
def securitytxt_links(spark, sf_dir):
    """Links in security files."""
    n = F.col("l_linenumber") % 3
    line = F.when(n == 0, _f(" Contact: mailto:sec@org%d.com", "l_partkey")).when(n == 1, _f("# Policy: https://org%d.com", "l_partkey")).otherwise(_f("Policy : https://org%d.com/p", "l_partkey"))
    return records.securitytxt_links(_per_order(_lines(spark, sf_dir), line).select("seed_id", F.array_join("x", "\n").alias("body")))


@query(f"with {URL_SQL}, {ANCHORS} select page_id, trim(href) as raw, trim(txt) as text, count(*) as links from lk where trim(href) <> '' group by 1, 2, 3")
def ownership_hint_links(spark, sf_dir):
    """Links that hint at an owner, those of a page that repeat counted."""
    return records.ownership_hint_links(ad.pages(spark, sf_dir)).groupBy("page_id", "raw", "text").agg(F.count("*").alias("links"))


SEARCHED = """l as (select l_orderkey as seed_id, l_partkey as p, min(l_suppkey) as s from lineitem where l_partkey % 6 <> 0 group by all),
 d as (select *, row_number() over (partition by seed_id, p % 40 order by p) as n from l), r as (select *, row_number() over (partition by seed_id order by p) as rank from d where n = 1)"""


def _search_bodies(spark, sf_dir):
    """Answers with one candidate per distinct part of an order, in order of parts; every sixth part has no evidence that counts."""
    p, s = F.col("p").cast("string"), F.col("s").cast("string")
    url = F.concat(F.lit("https://ref"), s, F.lit(".org/"))
    item = lambda u, t: F.struct(F.lit(t).alias("title"), u.alias("url"), F.lit("seen").alias("snippet"))
    other = F.when(F.col("p") % 6 == 0, F.concat(F.lit("ftp://x"), s)).otherwise(url)
    c = F.struct(F.col("p"), F.concat(F.lit("www.Org"), (F.col("p") % 40).cast("string"), F.lit(".com")).alias("root"), F.concat(F.lit(" part "), p).alias("summary"), F.array(item(other, "B"), item(other, "A"), item(F.concat(F.lit("mailto:"), s), "C")).alias("evidence"))
    parts = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("seed_id"), F.col("l_partkey").alias("p")).agg(F.min("l_suppkey").alias("s"))
    rows = parts.groupBy("seed_id").agg(F.sort_array(F.collect_list(c)).alias("candidates"))
    asked = F.array(F.lit(" Who "), F.lit("who"), _f("what %d", "seed_id"), F.lit(""))
    return rows.select("seed_id", F.concat(F.lit("```json\n"), F.to_json(F.struct(asked.alias("queries"), "candidates")), F.lit("\n```")).alias("body"))


@query(f"with {SEARCHED} select seed_id, rank, concat('org', p % 40, '.com') as root, concat('part ', p) as summary, concat('B https://ref', s, '.org/') as evidence from r where rank <= 10")
def search_candidates(spark, sf_dir):
    """Candidates of search answers, with their evidence."""
    rows = records.search_candidates(_search_bodies(spark, sf_dir), _rules(spark))
    return rows.withColumn("evidence", F.array_join(F.transform("evidence", lambda e: F.concat(e.title, F.lit(" "), e.url)), ","))


@query("select distinct l_orderkey as seed_id, unnest(['Who', concat('what ', l_orderkey)]) as query from lineitem")
def search_queries(spark, sf_dir):
    """Queries that search answers report."""
    return records.search_queries(_search_bodies(spark, sf_dir)).select("seed_id", "query")


@query("with l as (select l_orderkey as seed_id, l_partkey % 5 as r, l_partkey * 10 + l_linenumber as k, bool_or(l_partkey % 2 = 0) as collect from lineitem group by all), m as (select *, row_number() over (partition by seed_id, r order by k desc) as n from l) select seed_id, concat('org', r, '.com') as root, collect, least(1.0, k % 30 / 20.0)::double as confidence from m where n = 1")
def decisions_from_text(spark, sf_dir):
    """Decisions in answers; a root's last one counts."""
    p = F.col("l_partkey")
    k = (p * 10 + F.col("l_linenumber")).alias("k")
    d = F.struct(k, F.concat(F.lit("A.Org"), (p % 5).cast("string"), F.lit(".com")).alias("root"), (p % 2 == 0).alias("collect"), (k % 30 / 20.0).alias("confidence"), F.lit("x").alias("kind"), F.lit("y").alias("reason"))
    rows = _per_order(_lines(spark, sf_dir), d).select("seed_id", F.concat(F.lit("Here: "), F.to_json(F.struct(F.sort_array("x").alias("decisions")))).alias("body"))
    return records.decisions_from_text(rows, _rules(spark)).select("seed_id", "root", "collect", "confidence")


@query("select distinct concat('203.0.', user_id % 256, '.1') as ip, case when user_id % 9 = 0 then null else (user_id % 50)::int end as asn, concat('203.0.', user_id % 256, '.0/24') as cidr, case when user_id % 9 = 0 then null else concat('ORG ', user_id % 50) end as organization from events")
def ip_origin_rows(spark, sf_dir):
    """Networks of addresses from captured answers."""
    u = F.col("user_id")
    third, asn = (u % 256).cast("string"), F.when(u % 9 == 0, "NA").otherwise((u % 50).cast("string"))
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("203.0."), third, F.lit(".1")).alias("ip"), F.concat(F.lit('"'), asn, F.lit(" | 203.0."), third, F.lit('.0/24 | XX | "')).alias("origin"), F.concat(F.lit('"1 | XX | a | b | ORG '), asn, F.lit('"')).alias("network"))
    return records.ip_origin_rows(rows.distinct())


def _registered(spark, sf_dir):
    return table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey"))


def _rdap(spark, sf_dir):
    """RDAP answers of all customers; every fourth can't be read."""
    rows = _registered(spark, sf_dir)
    body = F.concat(
        F.lit('{"status":["Active","active","LOCKED"],"nameservers":[{"ldhName":"NS2.Host.com."},{"ldhName":"ns1.host.com"}],"events":[{"eventAction":"registration","eventDate":"2019-01-01T00:00:00Z"},'),
        F.lit('{"eventAction":"registration","eventDate":"2020-02-03T00:00:00Z"},{"eventAction":"expiration","eventDate":"soon"}],"entities":[{"roles":["registrant"],"vcardArray":["vcard",[["version",{},"text","4.0"],["fn",{},"text",""],["org",{},"text",["Org","'),
        F.col("c_name"), F.lit('"]],["email",{},"text","MAILTO:A@B.com"]]]},{"roles":["Registrant"],"vcardArray":["vcard",[["fn",{},"text","Second"]]]},{"roles":["registrar"],"publicIds":[{"identifier":" '), F.col("k").cast("string"),
        F.lit(' "}],"vcardArray":["vcard",[["fn",{},"text","Reg"]]]}]}'))
    return registrations.from_rdap(rows.select(_f("Dom%d.com.", "k").alias("domain"), F.when(F.col("k") % 4 == 3, "no answer").otherwise(body).alias("body")))


def _whois(spark, sf_dir):
    """WHOIS answers of all customers; every third tells nothing."""
    rows = _registered(spark, sf_dir)
    told = F.concat(F.lit("% note\nRegistrant name: \nRegistrant name: Whois "), F.col("c_name"), F.lit("\nRegistrar URL: https://r.example\nCreation date: 2018-05-06 07:08:09\nExpiration date: never\nExpiration date: 2030-01-02\nStatus: Paid\nName server: ns3.host.com\n"))
    return registrations.from_whois(rows.select(_f("dom%d.com", "k").alias("domain"), F.when(F.col("k") % 3 == 0, "% nothing\n").otherwise(told).alias("body")))


REG = "registrar_name, registrar_iana_id, registrar_url, created, expires, registrant_name, registrant_org, registrant_email, statuses, name_servers"
RDAP_SQL = "select concat('dom', c_custkey, '.com') as domain, 'Reg' as registrar_name, c_custkey::varchar as registrar_iana_id, null::varchar as registrar_url, '2020-02-03' as created, null::varchar as expires, 'Second' as registrant_name, concat('Org ', c_name) as registrant_org, 'a@b.com' as registrant_email, 'active,locked' as statuses, 'ns1.host.com,ns2.host.com' as name_servers from customer where c_custkey % 4 <> 3"
WHOIS_SQL = "select concat('dom', c_custkey, '.com') as domain, null::varchar as registrar_name, null::varchar as registrar_iana_id, 'https://r.example' as registrar_url, '2018-05-06' as created, '2030-01-02' as expires, concat('Whois ', c_name) as registrant_name, null::varchar as registrant_org, null::varchar as registrant_email, 'paid' as statuses, 'ns3.host.com' as name_servers from customer where c_custkey % 3 <> 0"


def _flat(df):
    day = [F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("created", "expires")]
    return df.select("domain", "registrar_name", "registrar_iana_id", "registrar_url", *day, "registrant_name", "registrant_org", "registrant_email", F.array_join("statuses", ",").alias("statuses"), F.array_join("name_servers", ",").alias("name_servers"))


@query(RDAP_SQL)
def registration_from_rdap(spark, sf_dir):
    """Registrations of RDAP answers."""
    return _flat(_rdap(spark, sf_dir))


@query(WHOIS_SQL)
def registration_from_whois(spark, sf_dir):
    """Registrations of WHOIS answers."""
    return _flat(_whois(spark, sf_dir))


@query(f"""select coalesce(a.domain, b.domain) as domain, {', '.join(f'coalesce(a.{c}, b.{c}) as {c}' for c in REG.split(', ')[:8])},
 concat_ws(',', a.statuses, b.statuses) as statuses, concat_ws(',', a.name_servers, b.name_servers) as name_servers from ({RDAP_SQL}) a full join ({WHOIS_SQL}) b on a.domain = b.domain""")
def registration_coalesce(spark, sf_dir):
    """One registration a domain from both kinds of answers."""
    return _flat(registrations.coalesced(_rdap(spark, sf_dir), _whois(spark, sf_dir)))


@query("""select l_orderkey as k, l_partkey as p, l_linenumber as n, case l_linenumber % 6 when 0 then concat('https://a.com/p', l_partkey) when 1 then concat('https://a.com/x/p', l_partkey, '?q=1') when 2 then concat('https://b.com/', l_partkey)
 when 3 then null when 4 then concat('HTTP://C.com/', l_partkey) else 'https://a.com/x/y?z' end as url from lineitem""")
def resolved_urls(spark, sf_dir):
    """Links resolved against their page."""
    p, n = ad.text("l_partkey"), F.col("l_linenumber") % 6
    raw = F.when(n == 0, F.concat(F.lit("/q/../p"), p)).when(n == 1, F.concat(F.lit("./p"), p, F.lit("?q=1#f"))).when(n == 2, F.concat(F.lit("//b.com/"), p)).when(n == 3, "mailto:a@b.com").when(n == 4, F.concat(F.lit("HTTP://C.com/../"), p)).otherwise("?z")
    return _lines(spark, sf_dir).select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("n"), names.resolve_url(F.lit("https://a.com/x/y?k=v"), raw).alias("url"))


@query("select event_id, case when event_id % 2 = 0 then concat('_spf.org', user_id % 9, '.com,mail', user_id % 5, '.net') else concat('org', user_id % 9, '.com') end as hosts from events")
def txt_domains(spark, sf_dir):
    """Host names in TXT records."""
    u = F.col("user_id")
    org = F.concat(F.lit("Org"), (u % 9).cast("string"), F.lit(".com"))
    spf = F.concat(F.lit('"v=spf1 include:_spf.'), org, F.lit(" ip4:10.0.0.0/8; rua=mailto:x@mail"), (u % 5).cast("string"), F.lit('.net,mailto:y" -all'))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(names.txt_domains(F.when(F.col("event_id") % 2 == 0, spf).otherwise(org)), ",").alias("hosts"))
