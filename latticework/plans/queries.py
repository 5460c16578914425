"""The engine's registered queries, and for each the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import keys
from latticework.operators import fold, graph, judged, windows
from latticework.session import folder, stored
from latticework.sources import pages as page_source
from latticework.streaming import event_log

from . import adapters as ad
from .adapters import OBSERVATIONS, OUTCOMES, RELATIONS, SEEDS, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


RANKED = """r0 as (select *, row_number() over (partition by type, asset_key order by seq) = 1 as first, kind = 'discovery' as found,
 case ownership_state when 'owned' then 3 when 'uncertain' then 2 when 'associated_infrastructure' then 1 else 0 end as own from o),
r1 as (select *, case when first and own = 0 then case when type = 'ip' then 1 else 3 end else own end as rank from r0),
r2 as (select *, coalesce(max(rank) over (partition by type, asset_key order by seq rows between unbounded preceding and 1 preceding), 0) as before from r1)"""
CANONICAL = f"""{OBSERVATIONS}, {RANKED},
r3 as (select *, (inclusion_reason <> '' and (found or first)) as fit, rank > before as raised from r2),
r4 as (select *, fit and (coalesce(sum(fit::int) over (partition by type, asset_key order by seq rows between unbounded preceding and 1 preceding), 0) = 0 or raised) as counts from r3),
g as (select type, asset_key, arg_min(id, seq) as asset_id, arg_min(enumeration_id, seq) as enumeration_id, min(seen_us) as first_seen_us,
  coalesce(string_agg(distinct lower(source), ', ' order by lower(source)) filter (where found), '') as sources, max(rank) as rank,
  arg_max(inclusion_reason, seq) filter (where counts) as given, count(*) filter (where found) as nf, count(*) filter (where found and not first) as nl, arg_min(source, seq) as fs, count(*) as observations
  from r4 group by type, asset_key),
ca as (select type, asset_key, asset_id, enumeration_id, first_seen_us, sources,
  case rank when 3 then 'owned' when 2 then 'uncertain' when 1 then 'associated_infrastructure' else '' end as ownership_state,
  case when given is not null then given when nl > 0 then case when nf = 1 then concat('Discovered via ', sources) else concat('Supported by ', nf, ' discovery observations from ', sources) end
       else concat('Discovered via ', fs) end as inclusion_reason, observations from g),
rooted as (select *, case when type = 'ip' then asset_key else regexp_extract(asset_key, '([^.]+\\.[^.]+)$', 1) end as root from ca)"""


@query(f"with {CANONICAL} select * from ca")
def canonical_assets(spark, sf_dir):
    """The central fold of observations."""
    return fold.canonical_assets(ad.observations(spark, sf_dir))


@query(f"with {OBSERVATIONS}, {RANKED} select id, asset_key, rank, before, rank > before as raised from r2")
def running_ownership(spark, sf_dir):
    """Ownership before each observation and whether it raised it."""
    return fold.ranked_observations(ad.observations(spark, sf_dir)).select("id", "asset_key", "rank", "before", "raised")


def _rules(spark: SparkSession) -> DataFrame:
    """Public suffixes of the tables' hosts; others pass a larger rule table."""
    return spark.createDataFrame([(s, False, False) for s in ("com", "net", "org")], "suffix string, is_wildcard boolean, is_exception boolean")


def _rooted(spark, sf_dir) -> DataFrame:
    return keys.attach_root(stored(canonical_assets(spark, sf_dir), "assets"), "asset_key", _rules(spark))


ORDER_SQL = "case when type = 'ip' then 2 when root = asset_key then 0 else 1 end, case when type = 'ip' then '' else root end, asset_key, first_seen_us, asset_id"
KIND_SQL = "case when type = 'ip' then 'ip' when root = asset_key then 'registrable' else 'subdomain' end"


def ordered_assets(spark, sf_dir) -> DataFrame:
    """Rooted assets with their kind and the columns of the export order: registrable domains, subdomains, addresses."""
    kind = F.when(F.col("type") == "ip", "ip").when(F.col("root") == F.col("asset_key"), "registrable").otherwise("subdomain")
    return _rooted(spark, sf_dir).withColumn("domain_kind", kind).withColumn("g", F.when(kind == "ip", 2).when(kind == "registrable", 0).otherwise(1)).withColumn("d", F.when(kind == "ip", "").otherwise(F.col("root")))


EXPORT_ORDER = ["g", "d", "asset_key", "first_seen_us", "asset_id"]


@query(f"with {CANONICAL} select asset_id, asset_key, root, {KIND_SQL} as domain_kind, row_number() over (order by {ORDER_SQL}) as position from rooted")
def export_order(spark, sf_dir):
    """Assets in export order, by ranges of it."""
    return windows.positions(ordered_assets(spark, sf_dir), EXPORT_ORDER).select("asset_id", "asset_key", "root", "domain_kind", "position")


@query(f"with {CANONICAL} select asset_id, row_number() over (order by case when type = 'ip' then 2 when root = asset_key then 0 else 1 end, case when type = 'ip' then '' else root end, first_seen_us desc, asset_key, asset_id) as position from rooted")
def read_model_order(spark, sf_dir):
    """Assets in the read model's order: within a root the latest first."""
    rows = ordered_assets(spark, sf_dir).withColumn("late", -F.col("first_seen_us"))
    return windows.positions(rows, ["g", "d", "late", "asset_key", "asset_id"]).select("asset_id", "position")


@query(f"""with {CANONICAL}, p as (select asset_id, case when type = 'ip' then null else root end as root, enumeration_id, asset_key as pos from rooted),
 c as (select a.asset_id, b.asset_id as other, b.pos, case when a.root = b.root then 1 else 2 end as k from p a join p b on a.asset_id <> b.asset_id and (a.root = b.root or a.enumeration_id = b.enumeration_id)),
 d as (select *, row_number() over (partition by asset_id order by k, pos) as rank from c)
 select asset_id, rank, other, case when k = 1 then 'Same Registrable Domain' else 'Same Enumeration' end as label from d where rank <= 8""")
def related_assets(spark, sf_dir):
    """Up to eight related assets of each asset."""
    rows = _rooted(spark, sf_dir).select("asset_id", F.when(F.col("type") != "ip", F.col("root")).alias("root"), "enumeration_id", F.col("asset_key").alias("pos"))
    return graph.related_assets(rows)


@query(f"with {OBSERVATIONS} select type, asset_key, count(*) filter (where kind = 'discovery') as discovered, count(*) filter (where kind = 'enrichment') as enriched, min(seen_us) as first_us, max(seen_us) as last_us, count(distinct enumeration_id) as enumerations from o group by type, asset_key")
def observation_summary(spark, sf_dir):
    """Counts by kind, first and last sight, enumerations of each asset."""
    obs = ad.observations(spark, sf_dir).groupBy("type", keys.asset_key(F.col("identifier")).alias("asset_key"))
    return obs.agg(F.count_if(F.col("kind") == "discovery").alias("discovered"), F.count_if(F.col("kind") == "enrichment").alias("enriched"), F.min("seen_us").alias("first_us"), F.max("seen_us").alias("last_us"), F.count_distinct("enumeration_id").alias("enumerations"))


@query(f"with {OBSERVATIONS} select type, asset_key, coalesce(string_agg(distinct source, ', ' order by source), '') as all_sources, coalesce(string_agg(distinct source, ', ' order by source) filter (where kind = 'discovery'), '') as discovery_sources, coalesce(string_agg(distinct source, ', ' order by source) filter (where kind = 'enrichment'), '') as enrichment_sources from o group by type, asset_key")
def sources_by_kind(spark, sf_dir):
    """Sources of each asset: all, of discovery, of enrichment."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    obs = ad.observations(spark, sf_dir).groupBy("type", keys.asset_key(F.col("identifier")).alias("asset_key"))
    return obs.agg(names(F.col("source")).alias("all_sources"), names(F.when(F.col("kind") == "discovery", F.col("source"))).alias("discovery_sources"), names(F.when(F.col("kind") == "enrichment", F.col("source"))).alias("enrichment_sources"))


@query(f"with {OBSERVATIONS}, f as (select type, asset_key, enumeration_id, min(seq) as sq from o group by all) select type, asset_key, string_agg(enumeration_id, ', ' order by sq) as enumerations from f group by type, asset_key")
def contributor_values(spark, sf_dir):
    """Enumerations of each asset in first-seen order."""
    obs = ad.observations(spark, sf_dir).groupBy("type", keys.asset_key(F.col("identifier")).alias("asset_key"), "enumeration_id").agg(F.min("seq").alias("at"))
    return obs.groupBy("type", "asset_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "enumeration_id"))), lambda x: x.enumeration_id), ", ").alias("enumerations"))


@query(f"with {OBSERVATIONS}, f as (select source, asset_key, min(seq) as sq from o group by all), t as (select *, row_number() over (partition by source order by sq, asset_key) as r from f) select source, string_agg(asset_key, ',' order by r) as samples from t where r <= 5 group by source")
def first_samples(spark, sf_dir):
    """The first five distinct hosts of each source."""
    obs = ad.observations(spark, sf_dir).withColumn("asset_key", keys.asset_key(F.col("identifier")))
    return windows.first_samples(obs, "source", "asset_key", "seq", 5)


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn, role, text) as rank, row_number() over (partition by conv_id order by turn, role, text) > 3 as truncated, cast(floor((row_number() over (partition by conv_id order by turn, role, text) - 1) / 2) as bigint) as batch from conversations")
def capped_batches(spark, sf_dir):
    """Turns of each conversation with rank, cap and batch of two."""
    order = ["turn", "role", "text"]
    return windows.fixed_batches(windows.cap_per_group(table(spark, sf_dir, "conversations"), "conv_id", order, 3), "conv_id", order, 2).select("conv_id", "turn", "rank", "truncated", "batch")


MERGED = f"""{OUTCOMES}, mo as (select collector, seed_id, scenario, root, bool_or(collect) as collect, max(confidence) as confidence, bool_or(explicit) as explicit,
 coalesce(arg_max(kind, eval_seq) filter (where collect and kind <> ''), arg_min(kind, eval_seq) filter (where kind <> '')) as kind from oc group by all)"""


@query(f"with {MERGED} select * from mo")
def merged_outcomes(spark, sf_dir):
    """One decision per group and root."""
    return judged.merged_outcomes(ad.outcomes(spark, sf_dir))


@query(f"with {MERGED} select collector, seed_id, scenario, count(*) filter (where collect) as n_accepted, count(*) filter (where not collect) as n_discarded, coalesce(string_agg(root, ',' order by root) filter (where collect), '') as accepted, coalesce(string_agg(root, ',' order by root) filter (where not collect), '') as discarded, max(confidence) as top_confidence from mo group by collector, seed_id, scenario")
def judge_summary(spark, sf_dir):
    """Accepted and discarded roots by collector, seed and scenario."""
    return judged.judge_summary(ad.outcomes(spark, sf_dir))


@query(f"with {OUTCOMES} select seed_id, coalesce(string_agg(distinct root, ',' order by root) filter (where collect), '') as accepted, coalesce(string_agg(distinct root, ',' order by root) filter (where not collect), '') as discarded from oc group by seed_id")
def roots_for_seed(spark, sf_dir):
    """Root sets of each seed."""
    return judged.roots_for_seed(ad.outcomes(spark, sf_dir))


@query(f"with {OUTCOMES}, known as (select distinct concat('root', s_nationkey * 3 % 97, '.com') as root from supplier) select seed_id, root, string_agg(distinct collector, ',' order by collector) as collectors, string_agg(distinct scenario, ',' order by scenario) as scenarios, count(*) filter (where explicit) as explicit, count(*) filter (where not explicit) as implicit from oc a where not collect and not exists (select 1 from oc b where b.collect and a.seed_id = b.seed_id and a.root = b.root) and root not in (select root from known) group by seed_id, root")
def discarded_candidates(spark, sf_dir):
    """Roots that no decision collected and that are not known."""
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("root"), (F.col("s_nationkey") * 3 % 97).cast("string"), F.lit(".com")).alias("root")).distinct()
    return judged.discarded_candidates(ad.outcomes(spark, sf_dir), known)


@query(f"with {OUTCOMES}, a as (select concat(seed_id, '|', root) as seed_key, bool_or(explicit and kind = 'f' and confidence > 0.9) as reasoned, max(confidence) as confidence, count(distinct concat(collector, '|', kind)) as signals from oc group by 1) select *, reasoned or confidence >= 0.9 or signals >= 2 as promoted from a")
def promote_candidates(spark, sf_dir):
    """Which candidates have enough evidence to become seeds."""
    evidence = ad.outcomes(spark, sf_dir).select(F.concat_ws("|", "seed_id", "root").alias("seed_key"), F.col("collector").alias("source"), "kind", "confidence", (F.col("explicit") & (F.col("kind") == "f") & (F.col("confidence") > 0.9)).alias("reasoned"))
    return judged.promote_candidates(evidence)


@query(f"with {OUTCOMES} select root, min(eval_seq) filter (where not collect) as opened_seq, arg_min(case when confidence < 0.8 then 'pending_review' else 'auto_rejected' end, eval_seq) filter (where not collect) as status, arg_min(collector, eval_seq) filter (where not collect) as opened_by, arg_max(collector, eval_seq) as last_collector, arg_max(confidence, eval_seq) as last_confidence from oc group by root having count(*) filter (where not collect) > 0")
def review_queue(spark, sf_dir):
    """Roots that wait for a review, or were rejected."""
    return judged.review_queue(ad.outcomes(spark, sf_dir))


@query("select d.doc_id, coalesce(l.quality = 1, false) as collect, l.doc_id is not null as explicit from documents d left join labels l on d.doc_id = l.doc_id")
def decisions_to_outcomes(spark, sf_dir):
    """Documents with their label as decision; without one they are not collected."""
    decisions = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("collect"))
    return judged.decisions_to_outcomes(table(spark, sf_dir, "documents").select("doc_id"), decisions, "doc_id")


RESOLVED = f"{RELATIONS}, re as (select r.*, f.asset_id as from_asset_id, t.asset_id as to_asset_id from (select distinct * from rel) r left join ga f on lower(r.from_identifier) = lower(f.identifier) left join ga t on lower(r.to_identifier) = lower(t.identifier))"


def _resolved(spark, sf_dir) -> DataFrame:
    return graph.resolve_endpoints(ad.relations(spark, sf_dir), ad.graph_assets(spark, sf_dir))


@query(f"with {RESOLVED} select id, kind, from_asset_id, to_asset_id from re")
def resolve_endpoints(spark, sf_dir):
    """Edges with the ids of both ends."""
    return _resolved(spark, sf_dir).select("id", "kind", "from_asset_id", "to_asset_id")


@query(f"with {RESOLVED} select id, case when from_asset_id is null and to_asset_id is null then 'from,to' when from_asset_id is null then 'from' else 'to' end as missing from re where from_asset_id is null or to_asset_id is null")
def dangling_refs(spark, sf_dir):
    """Edges whose ends don't exist."""
    return graph.dangling(_resolved(spark, sf_dir))


@query(f"with {RESOLVED}, e as (select id, kind, from_asset_id as a, to_asset_id as b from re where from_asset_id is not null and to_asset_id is not null union select id, kind, to_asset_id, from_asset_id from re where from_asset_id is not null and to_asset_id is not null) select a as asset_id, count(*) as relations, count(distinct b) as peers, string_agg(distinct kind, ',' order by kind) as kinds from e group by a")
def relation_summary(spark, sf_dir):
    """Edges, peers and kinds of each asset."""
    return graph.relation_summary(_resolved(spark, sf_dir))


@query(f"with {SEEDS} select domain as seed_key, arg_min(id, seq) as id, arg_min(company_name, seq) as company_name, arg_min(industry, seq) as industry, max(confidence) as confidence, count(*) as merged, count(distinct lower(trim(company_name))) - 1 as conflicts from sd group by domain")
def merge_seeds(spark, sf_dir):
    """Seeds of one domain become one."""
    return fold.merge_seeds(ad.seeds(spark, sf_dir))


@query(f"with {SEEDS}, f as (select domain, arg_min(lower(company_name), seq) as first from sd group by 1) select distinct sd.domain as seed_key, 'seed_merge' as source, 'company_name' as kind, lower(company_name) as value from sd join f on f.domain = sd.domain where lower(company_name) <> first")
def seed_evidence(spark, sf_dir):
    """Names of companies that merged seeds had beside the first."""
    return fold.seed_evidence(ad.seeds(spark, sf_dir))


@query("with ips as (select distinct unnest(regexp_extract_all(text, '\\b[0-9]{1,3}(?:\\.[0-9]{1,3}){3}\\b')) as ip from documents), n as (select ip, cast(split_part(ip, '.', 1) as bigint) * 16777216 + cast(split_part(ip, '.', 2) as bigint) * 65536 + cast(split_part(ip, '.', 3) as bigint) * 256 + cast(split_part(ip, '.', 4) as bigint) as n from ips where len(list_filter(string_split(ip, '.'), lambda x: cast(x as int) > 255 or (len(x) > 1 and x[1] = '0'))) = 0), p as (select distinct n - n % 256 as base, 24 as len from n union select distinct n - n % 65536, 16 from n) select ip, concat(base, '/', len) as cidr from n join p on n >= base and n < base + cast(power(2, 32 - len) as bigint)")
def ip_in_cidr(spark, sf_dir):
    """Addresses that occur in texts, by the prefixes that hold them."""
    ips = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"), F.lit(0))).alias("ip")).distinct()
    n = ips.select(keys.ip4_number(F.col("ip")).alias("n")).filter("n is not null")
    prefixes = n.select((F.col("n") - F.col("n") % 256).alias("base"), F.lit(24).alias("len")).union(n.select((F.col("n") - F.col("n") % 65536).alias("base"), F.lit(16).alias("len"))).distinct()
    return graph.ip_in_cidr(ips, prefixes.withColumn("cidr", F.concat(F.col("base").cast("string"), F.lit("/"), F.col("len").cast("string"))))


URL_SQL = """u0 as (select page_id, url, html, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) as site,
  regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path, list_transform(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' and not p like 'utm\\_%' escape '\\'), lambda p: lower(split_part(p, '=', 1)) || '=' || substr(p, strpos(p, '=') + 1)) as q from pages),
 u as (select page_id, url, html, site, site || case when path = '' then '/' else path end || case when len(q) = 0 then '' else '?' || array_to_string(list_sort(q), '&') end as normalized from u0)"""


@query(f"with {URL_SQL} select page_id, normalized, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) as host from u")
def normalized_urls(spark, sf_dir):
    """Normal form and host of each page's URL."""
    return table(spark, sf_dir, "pages").select("page_id", keys.normalized_url(F.col("url")).alias("normalized"), keys.url_host(F.col("url")).alias("host"))


def _class_sql(*texts: str) -> str:
    """The class of a link by keywords, in order of precedence, in each text in turn."""
    cases = " ".join(f"when regexp_matches({t}, '{'|'.join(words)}') then '{label}'" for t in texts for label, words in keys.LINK_CLASSES)
    return f"case {cases} else 'anchor' end"


_PATH_SQL = "url_encode(href)"
for _c in "/,$&+:;=@":  # stay as they are in a path
    _PATH_SQL = f"replace({_PATH_SQL}, '%{ord(_c):02X}', '{_c}')"


#: Anchors of the pages, whose markup is regular, with their texts.
ANCHORS = """an as (select *, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) as hrefs, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) as texts from u),
 lk as (select page_id, url, site, normalized, replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as title, unnest(hrefs) as href, replace(replace(replace(unnest(texts), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as txt, unnest(range(len(hrefs))) as i from an)"""


@query(f"""with {URL_SQL}, {ANCHORS},
 t as (select *, site || case when regexp_full_match(href, '[A-Za-z0-9_.~!$&''()*+,;=:@/%-]*') then href else {_PATH_SQL} end as target_url, regexp_replace(trim(txt), '\\s+', ' ', 'g') as anchor_text from lk where href like '/%' and not regexp_matches(href, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)')),
 c as (select *, {_class_sql("lower(target_url || ' ' || anchor_text)", "lower(normalized)")} as relation from t),
 f as (select page_id, url, title, target_url, relation, site, arg_min(anchor_text, i) as anchor_text, min(i) as i from c group by page_id, url, title, target_url, relation, site, lower(anchor_text)),
 r as (select *, row_number() over (partition by page_id order by i) - 1 as pos from f)
 select page_id, url, regexp_replace(trim(title), '\\s+', ' ', 'g') as title, pos, target_url, regexp_extract(target_url, '://([^/]*)', 1) as target_host, anchor_text, relation, false as nofollow from r where pos < 128""")
def page_links(spark, sf_dir):
    """Links of all pages with their relation."""
    return page_source.page_links(ad.pages(spark, sf_dir))


@query("with e as (select doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]+'), lambda x: lower(split_part(x, '@', 2))))) as host from documents) select regexp_extract(host, '([^.]+\\.[^.]+)$', 1) as root, count(distinct doc_id) as documents, count(distinct host) as hosts from e group by 1")
def email_roots(spark, sf_dir):
    """Registrable roots of e-mail addresses in texts, with their documents."""
    mail = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+"), F.lit(0))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.transform(mail, lambda x: F.lower(F.split(x, "@")[1])))).alias("host"))
    return keys.attach_root(rows, "host", _rules(spark)).groupBy("root").agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("host").alias("hosts"))


@query("select trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) as org, n_name, count(*) as seeds from customer join nation on c_nationkey = n_nationkey group by 1, 2")
def org_keys(spark, sf_dir):
    """Organisation keys of seeds by nation."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(keys.org_key(F.col("c_name")).alias("org"), "n_name").agg(F.count("*").alias("seeds"))


@query("select event_id, lower(event_type) as kind, value from events where trim(event_type) <> ''")
def event_log_stream(spark, sf_dir):
    """Events streamed into an append-only log, read back."""
    base = folder(spark)
    return event_log.append_events(spark, f"{sf_dir}/events.parquet", f"{base}/log", f"{base}/progress").select("event_id", "kind", "value")
