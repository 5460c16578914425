"""More registered queries: captured responses, details, budgets, exports, the live fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.functions import keys
from latticework.operators import details, fold, judged, readmodel
from latticework.session import folder, spread
from latticework.sources import captures, exports
from latticework.streaming import live_assets as live

from . import adapters as ad
from . import queries as base
from .adapters import OBSERVATIONS, OUTCOMES, table
from .queries import CANONICAL, ORACLE_SQL, query


def _bodies(spark, sf_dir):
    """One captured body per order, from its line items; every fiftieth is an error."""
    host = F.concat(F.lit("Host"), ad.text("l_partkey"), F.lit(".org"), (F.col("l_suppkey") % 7).cast("string"), F.lit(".com.,203.0.113."), (F.col("l_partkey") % 300).cast("string"))
    body = F.array_join(F.collect_list(host), "\n")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("seed_id")).agg(F.when(F.col("seed_id") % 50 == 0, "error check your search parameter").otherwise(body).alias("body"))


@query("with l as (select * from lineitem where l_orderkey % 50 <> 0) select l_orderkey as seed_id, 'domain' as type, concat('host', l_partkey, '.org', l_suppkey % 7, '.com') as identifier from l union all select l_orderkey, 'ip', concat('203.0.113.', l_partkey % 300) from l where l_partkey % 300 < 256")
def host_search_rows(spark, sf_dir):
    """Hosts and addresses of captured host searches."""
    return captures.host_search_rows(_bodies(spark, sf_dir))


@query("select distinct l_orderkey as seed_id, 'error check your search parameter' as error from lineitem where l_orderkey % 50 = 0")
def quarantine_error_bodies(spark, sf_dir):
    """Captured bodies that are errors."""
    return captures.rejected_bodies(_bodies(spark, sf_dir))


@query("select distinct lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) as host from pages")
def archive_url_hosts(spark, sf_dir):
    """Hosts of captured URLs."""
    return captures.archive_hosts(table(spark, sf_dir, "pages"))


STAGED = "select *, case source when 'crawler_collector' then 'completed' when 'dns_collector' then 'cached' when 'crt.sh' then 'retryable' else 'failed' end as stage, case when seq % 2 = 0 then 'A' else 'TXT' end as rt, concat('v', seq % 5) as rv, case when seq % 3 = 0 then null else id end as value from o"


@query(f"with {OBSERVATIONS}, s as ({STAGED}), p as (select *, case stage when 'completed' then 4 when 'cached' then 3 when 'retryable' then 2 else 1 end as pr from s), r as (select type, asset_key, string_agg(distinct concat(rt, ' ', rv), ', ' order by concat(rt, ' ', rv)) as records, arg_max(value, seq) filter (where value is not null) as last_value from p group by all), t as (select type, asset_key, stage, row_number() over (partition by type, asset_key order by pr desc, seq desc) as n from p) select r.type, r.asset_key, records, last_value, stage from r join t on r.type = t.type and r.asset_key = t.asset_key and n = 1")
def asset_details(spark, sf_dir):
    """Records, last value and best stage of each asset."""
    source, seq = F.col("source"), F.col("seq")
    stage = F.when(source == "crawler_collector", "completed").when(source == "dns_collector", "cached").when(source == "crt.sh", "retryable").otherwise("failed")
    obs = ad.observations(spark, sf_dir).select("type", keys.asset_key(F.col("identifier")).alias("asset_key"), "seq", stage.alias("stage"), F.when(seq % 2 == 0, "a").otherwise("txt").alias("record_type"), F.concat(F.lit("V"), (seq % 5).cast("string")).alias("record"), F.when(seq % 3 != 0, F.col("id")).alias("value"))
    return details.asset_details(obs)


@query(f"with {OBSERVATIONS} select enumeration_id, case when seq % 3 = 0 then concat('2001:db8::', seq % 100) else concat('203.0.113.', seq % 200) end as ip, arg_min(asset_key, seq) as domain, case when seq % 3 = 0 then 'dns_aaaa' else 'dns_a' end as kind from o where type = 'domain' group by 1, 2, 4")
def ip_edges(spark, sf_dir):
    """Edges from domains to the addresses of their records."""
    obs = ad.observations(spark, sf_dir).filter("type = 'domain'")
    ip = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("2001:DB8::"), (F.col("seq") % 100).cast("string"))).otherwise(F.concat(F.lit("203.0.113."), (F.col("seq") % 200).cast("string")))
    return details.ip_edges(obs.select("enumeration_id", keys.asset_key(F.col("identifier")).alias("domain"), ip.alias("ip"), "seq"))


@query(f"with {OBSERVATIONS}, l as (select enumeration_id as seed_id, concat('org', seq % 7, '.com') as root, asset_key as referrer, inclusion_reason as relation, source as sample, seq from o), c as (select seed_id, root, count(*) as links, count(distinct referrer) as referrers, round(least(0.85, 0.45 + 0.05 * count(distinct referrer) + case when count(*) filter (where relation <> '') > 0 then 0.05 else 0 end), 2)::double as confidence from l group by all), f as (select seed_id, root, sample, min(seq) as sq from l group by all), t as (select *, row_number() over (partition by seed_id, root order by sq, sample) as r from f), s as (select seed_id, root, string_agg(sample, ',' order by r) as samples from t where r <= 5 group by all) select * from c join s using (seed_id, root)")
def outbound_roots(spark, sf_dir):
    """Roots outside a seed's scope, with the evidence of the links to them."""
    obs = ad.observations(spark, sf_dir)
    return details.outbound_roots(obs.select(F.col("enumeration_id").alias("seed_id"), F.concat(F.lit("org"), (F.col("seq") % 7).cast("string"), F.lit(".com")).alias("root"), keys.asset_key(F.col("identifier")).alias("referrer"), F.col("inclusion_reason").alias("relation"), F.col("source").alias("sample"), "seq"))


@query("with p as (select c_nationkey as seed_id, c_custkey as pos, c_custkey * 4096 as base, 22 + c_custkey % 9 as len from customer), a as (select seed_id, pos, unnest(range(base, base + least(cast(power(2, 32 - len) as bigint), 256))) as n from p), r as (select *, row_number() over (partition by seed_id order by pos, n) as k from a) select seed_id, n from r where k <= 512")
def ip_budget(spark, sf_dir):
    """Addresses of announced prefixes within the budgets."""
    c = F.col("c_custkey")
    return details.ip_budget(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("seed_id"), c.alias("pos"), (c * 4096).cast("bigint").alias("base"), (22 + c % 9).cast("int").alias("len")))


@query("select event_type as kind, count(*) as issues, arg_min(user_id, event_id) as first from events group by event_type")
def issue_counts(spark, sf_dir):
    """Issues per kind, with the first."""
    return details.issue_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("sample"), F.col("event_id").alias("seq")))


@query("with e as (select distinct l_orderkey as k from lineitem where l_returnflag = 'R'), w as (select distinct o_orderkey as k from orders where o_orderstatus = 'O') select coalesce(e.k, w.k) as asset_id, case when w.k is not null then 'upsert' else 'delete' end as action from e full join w on e.k = w.k")
def sync_traces(spark, sf_dir):
    """Upserts and deletes that turn one set of traces into another."""
    existing = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("asset_id")).distinct()
    return details.sync_actions(existing, table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("asset_id")).distinct(), "asset_id")


@query(f"select c.type, c.asset_key, asset_id, ownership_state, inclusion_reason, observations, enumerations, all_sources, discovery_sources, enrichment_sources, first_us, last_us from ({ORACLE_SQL['canonical_assets']}) c join ({ORACLE_SQL['contributor_values']}) v on c.type = v.type and c.asset_key = v.asset_key join ({ORACLE_SQL['sources_by_kind']}) s on c.type = s.type and c.asset_key = s.asset_key join (select type, asset_key, first_us, last_us from ({ORACLE_SQL['observation_summary']})) o on c.type = o.type and c.asset_key = o.asset_key")
def asset_rows(spark, sf_dir):
    """The read model's row of each asset; its parts are dealt by the same key."""
    rows, by = base.canonical_assets(spark, sf_dir).drop("enumeration_id", "first_seen_us", "sources"), ["type", "asset_key"]
    for part in (base.contributor_values, base.sources_by_kind):
        rows = rows.join(part(spark, sf_dir), by)
    return rows.join(base.observation_summary(spark, sf_dir).select(*by, "first_us", "last_us"), by)


@query(f"""with {CANONICAL} select asset_id, {base.KIND_SQL} as domain_kind, case when type = 'ip' then '' else root end as registrable_domain, type, asset_key as identifier, sources as source, strftime(make_timestamp(first_seen_us), '%Y-%m-%d %H:%M:%S') as date from rooted""")
def export_csv(spark, sf_dir):
    """Assets written as CSV with a header, in export order over the files and inside each, read back."""
    path = folder(spark)
    exports.write_csv(base.ordered_assets(spark, sf_dir), base.EXPORT_ORDER, path)
    rows = exports.read_csv(spark, path)
    return rows.toDF(*(c.lower().replace(" ", "_") for c in rows.columns))


DETAILS_SQL = f"""{OBSERVATIONS}, dt as (select *, seq % 5 as n, type = 'domain' as d from o),
 rc as (select type, asset_key, string_agg(distinct x, ', ' order by x) as records from (select type, asset_key, unnest([concat('A 10.0.0.', seq % 3), concat('MX mail', n, '.com')]) as x from dt where d and source = 'dns_collector') group by 1, 2),
 da as (select type, asset_key, string_agg(concat(k, '=', v), ', ' order by k) as data from (select type, asset_key, concat('k', n) as k, max_by(seq, seq) as v from dt group by 1, 2, 3) group by 1, 2),
 st as (select type, asset_key, string_agg(concat(k, '=', v), ', ' order by k) as states, max(v) filter (where k = 'domain_enricher') as own from (select type, asset_key, case when n = 4 then 'ip_enricher' else 'domain_enricher' end as k,
   arg_max(case n when 0 then 'Completed' when 1 then 'cached' when 2 then 'retryable' else 'failed' end, case n when 0 then 4 when 1 then 3 when 2 then 2 else 1 end * 100000000000 + seq) as v from dt where kind = 'enrichment' group by 1, 2, 3) group by 1, 2),
 pl as (select type, asset_key, bool_or(d and seq % 17 = 0) as is_catch_all, arg_min(concat('Org ', n), seq) filter (where d and n > 2) as registrant_org, string_agg(distinct concat('ns', n, '.net'), ',' order by concat('ns', n, '.net')) filter (where d and n > 1) as name_servers,
   arg_min(seq % 4, seq) filter (where not d and seq % 4 <> 0)::int as asn, arg_min(concat('Net ', n), seq) filter (where not d and n > 2) as organization, arg_min(concat('p', seq, '.net'), seq) filter (where not d and n = 1) as ptr from dt group by 1, 2)"""


@query(f"""with {DETAILS_SQL} select pl.type, pl.asset_key, coalesce(records, '') as records, is_catch_all, registrant_org, coalesce(name_servers, '') as name_servers, asn, organization, ptr, data, coalesce(states, '') as states,
 case when pl.type = 'domain' then case when records is not null then 'resolved' when lower(own) in ('completed', 'cached') then 'unresolved' when lower(own) in ('failed', 'retryable') then 'lookup_failed' else 'not_checked' end end as status,
 coalesce(records like '%A 10%' or records like '%MX %', false) as live
 from pl left join rc on rc.type = pl.type and rc.asset_key = pl.asset_key left join da on da.type = pl.type and da.asset_key = pl.asset_key left join st on st.type = pl.type and st.asset_key = pl.asset_key""")
def merged_details(spark, sf_dir):
    """What sightings tell of each asset, folded, with its resolution status."""
    rows = fold.merged_details(ad.detailed_observations(spark, sf_dir))
    pairs = lambda m, v: F.array_join(F.transform(F.map_entries(m), lambda x: F.concat(x["key"], F.lit("="), v(x["value"]))), ", ")
    return rows.select(
        "type", "asset_key", F.array_join(F.transform("records", lambda r: F.concat(r["type"], F.lit(" "), r["value"])), ", ").alias("records"), "is_catch_all", "rdap.registrant_org",
        F.array_join("rdap.name_servers", ",").alias("name_servers"), "asn", "organization", "ptr", pairs(F.col("data"), lambda v: v).alias("data"), F.coalesce(pairs(F.col("states"), lambda v: v.status), F.lit("")).alias("states"),
        fold.resolution_status(F.col("type"), F.col("records"), F.col("states")).alias("status"), fold.live_dns(F.col("records")).alias("live"),
    )


@query(f"""with md as ({ORACLE_SQL['merged_details']}), ca as ({ORACLE_SQL['canonical_assets']}), ql as (select type, asset_key, max(seq) as late from (select event_id as seq, * from events) e join (select id, type, asset_key from (with {OBSERVATIONS} select * from o)) x on x.id = concat('obs-', event_id) where seq % 5 = 0 group by 1, 2)
 select md.type, md.asset_key, concat_ws(' | ', 'Ownership ' || nullif(ownership_state, ''), 'Reason ' || nullif(inclusion_reason, ''), 'Resolution ' || status, 'DNS ' || nullif(replace(replace(replace(records, 'A 10', 'A:10'), 'MX mail', 'MX:mail'), ', ', '; '), ''), case when is_catch_all then 'Catch-all' end,
  'RegistrantOrg ' || registrant_org, 'Nameservers ' || nullif(replace(name_servers, ',', ', '), ''), 'ASN ' || asn::varchar, 'Org ' || organization, 'PTR ' || ptr, 'CIDR ' || late::varchar) as details
 from md join ca on ca.type = md.type and ca.asset_key = md.asset_key left join ql on ql.type = md.type and ql.asset_key = md.asset_key""")
def details_line(spark, sf_dir):
    """All that is known of each asset in one line; one of the enrichment keys stands for the prefix."""
    rows = fold.merged_details(ad.detailed_observations(spark, sf_dir))
    rows = rows.withColumn("status", fold.resolution_status(F.col("type"), F.col("records"), F.col("states"))).withColumn("data", F.create_map(F.lit("cidr"), F.try_element_at("data", F.lit("k0"))))
    told = base.canonical_assets(spark, sf_dir).select("type", "asset_key", "ownership_state", "inclusion_reason")
    return readmodel.details_line(rows.join(told, ["type", "asset_key"])).select("type", "asset_key", "details")


@query(f"with {OBSERVATIONS} select type, asset_key, count(*) as observations, min(seen_us) as first_us, max(seen_us) as last_us from o group by type, asset_key")
def live_assets(spark, sf_dir):
    """Sightings streamed into the live fold."""
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*events.parquet").parquet(sf_dir)
    base_dir = folder(spark)
    return live.live_assets(spark, ad.observations_of(events), f"{base_dir}/live", f"{base_dir}/progress")


@query("select distinct l_orderkey as seed_id, unnest([concat('Host', l_partkey, '.com'), concat('www.org', l_suppkey % 7, '.com')]) as name from lineitem")
def ct_names(spark, sf_dir):
    """Names in captured certificate logs, one body per order."""
    value = F.concat(F.lit("*.Host"), ad.text("l_partkey"), F.lit(".com\n www.org"), (F.col("l_suppkey") % 7).cast("string"), F.lit(".com\n"))
    return captures.ct_names(spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), "l_orderkey").groupBy(F.col("l_orderkey").alias("seed_id")).agg(F.to_json(F.collect_list(F.struct(value.alias("name_value")))).alias("body")))


def _sitemaps(spark, sf_dir):
    """One body per order; every tenth has another root, every seventh of the others lacks its end."""
    loc = F.concat(F.lit("<url><loc> https://host"), ad.text("l_partkey"), F.lit(".com/p/"), ad.text("l_linenumber"), F.lit("\n</loc></url>"))
    name = F.when(F.col("seed_id") % 10 == 0, "feed").otherwise("urlset")
    end = F.when((F.col("seed_id") % 7 == 0) & (F.col("seed_id") % 10 != 0), "other").otherwise(name)
    body = F.concat(F.lit('<?xml version="1.0"?><'), name, F.lit(' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.collect_list(loc), ""), F.lit("</"), end, F.lit(">"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("seed_id")).agg(body.alias("body"))


@query("select l_orderkey as seed_id, concat('https://host', l_partkey, '.com/p/', l_linenumber) as loc from lineitem where l_orderkey % 10 <> 0 and l_orderkey % 7 <> 0")
def sitemap_locs(spark, sf_dir):
    """Locations in captured sitemaps."""
    return captures.sitemap_locs(_sitemaps(spark, sf_dir))


@query("select distinct l_orderkey as seed_id, case when l_orderkey % 10 = 0 then 'unsupported sitemap root \"feed\"' else 'no well-formed XML: mismatched tag' end as error from lineitem where l_orderkey % 10 = 0 or l_orderkey % 7 = 0")
def sitemap_errors(spark, sf_dir):
    """Captured bodies that are no sitemaps: every tenth has another root, every seventh of the others is cut short."""
    return captures.sitemap_errors(_sitemaps(spark, sf_dir)).select("seed_id", F.regexp_replace("error", ": line.*$", "").alias("error"))


@query(f"with {OUTCOMES}, e as (select seed_id as seed_key, collector as source, kind, root as value, max(confidence) as confidence, bool_or(explicit) as reasoned, min(eval_seq) as sq from oc group by 1, 2, 3, 4) select seed_key, source, kind, value, confidence, reasoned, row_number() over (partition by seed_key order by sq) as position from e")
def merge_evidence(spark, sf_dir):
    """Evidence of each seed, repeats merged."""
    rows = ad.outcomes(spark, sf_dir).select(F.col("seed_id").alias("seed_key"), F.col("collector").alias("source"), "kind", F.col("root").alias("value"), "confidence", F.col("explicit").alias("reasoned"), F.col("eval_seq").alias("seq"))
    return judged.merge_evidence(rows)


@query(f"with {OUTCOMES}, c as (select distinct seed_id, root from oc where collect and confidence >= 0.5), d as (select concat('root', s_nationkey * 3 % 97, '.com') as root, bool_or(s_nationkey % 2 = 0) as collect from supplier group by 1) select seed_id, c.root, case when collect then 'accepted' when not collect then 'rejected' else 'pending' end as decision from c left join d on c.root = d.root")
def promotion_gate(spark, sf_dir):
    """Candidates that pass the confidence gate, by the prior reviews of their roots."""
    found = ad.outcomes(spark, sf_dir).filter(judged.confidence_gate(F.col("collect"), F.col("confidence"))).select("seed_id", "root").distinct()
    key = F.col("s_nationkey")
    reviews = table(spark, sf_dir, "supplier").groupBy(F.concat(F.lit("root"), (key * 3 % 97).cast("string"), F.lit(".com")).alias("root")).agg(F.bool_or(key % 2 == 0).alias("collect"))
    return judged.promotion_gate(found, reviews)
