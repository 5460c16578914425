"""Registered queries over waves, the lineage read model, snapshots, exports and streamed candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.functions import keys
from latticework.operators import fold, frontier, judged, readmodel, trees
from latticework.session import folder, stored
from latticework.sources import pages, snapshots
from latticework.streaming import candidates

from . import adapters as ad
from . import enriched, reports
from . import queries as base
from .adapters import OBSERVATIONS, OUTCOMES, RELATIONS, SEEDS, table
from .collected import _f
from .queries import CANONICAL, ORACLE_SQL, query

#: Evidence that collecting for one key tells of another: each line item, of 64 keys for each supplier, whose own are the seeds.
EVIDENCE = "ev as (select concat('k', l_orderkey % (select count(*) * 64 from supplier) + 1) as parent_key, concat('k', l_partkey * 7 % (select count(*) * 64 from supplier) + 1) as seed_key, concat('s', l_linenumber % 2) as source, lower(l_linestatus) as kind, round(l_discount * 9.5, 3) as confidence, false as reasoned from lineitem)"


def _evidence(spark, sf_dir):
    size = table(spark, sf_dir, "supplier").count() * 64
    key = lambda c: F.concat(F.lit("k"), (c % size + 1).cast("string"))
    return table(spark, sf_dir, "lineitem").select(key(F.col("l_orderkey")).alias("parent_key"), key(F.col("l_partkey") * 7).alias("seed_key"), F.concat(F.lit("s"), (F.col("l_linenumber") % 2).cast("string")).alias("source"), F.lower("l_linestatus").alias("kind"), F.round(F.col("l_discount") * 9.5, 3).alias("confidence"), F.lit(False).alias("reasoned"))


def _waves(waves: int = 3) -> str:
    sql = f"with {EVIDENCE}, k0 as (select concat('k', s_suppkey) as seed_key, 0 as wave from supplier), t0 as (select * from ev where false)"
    for w in range(1, waves + 1):
        sql += f""", t{w} as (select * from t{w - 1} union all select * from ev where parent_key in (select seed_key from k{w - 1} where wave = {w - 1})),
 k{w} as (select * from k{w - 1} union all select seed_key, {w} from t{w} where seed_key not in (select seed_key from k{w - 1}) group by seed_key having bool_or(reasoned) or max(confidence) >= 0.9 or count(distinct concat(source, '|', kind)) >= 2)"""
    return f"{sql} select * from k{waves} union all select distinct seed_key, {waves + 1} from t{waves} where seed_key not in (select seed_key from k{waves})"


@query(_waves())
def expand_frontier(spark, sf_dir):
    """Seeds, one for each supplier, and the waves in which others were promoted."""
    seeds = table(spark, sf_dir, "supplier").select(_f("k%d", "s_suppkey").alias("seed_key"))
    return frontier.expand_frontier(seeds, _evidence(spark, sf_dir))


#: Pages are parts; a supplier is a seed whose scope are the parts of its remainder. Links lead from the part that an order numbers to one of the same scope.
LINKS = """sc as (select count(*) as m, (select count(*) from part) as size from supplier),
lk as (select l_orderkey % size + 1 as src, l_partkey // m * m + (l_orderkey % size + 1) % m as dst, min(l_linenumber * 10000000 + l_partkey) as pos from lineitem, sc group by 1, 2)"""


def _reached(most: int, steps: int, cap_queue: bool = False) -> str:
    sql = f"with {LINKS}, q0 as (select s_suppkey % m as seed, s_suppkey as url, s_suppkey as ord, 0 as depth from supplier, sc), v as (select 0 as seed, 0 as url, 0 as depth, 0::bigint as position where false)"
    prev = "v"
    for s in range(steps):
        fresh = f"select h.seed, dst as url, min(h.position * 100000000000 + lk.pos) as ord, {s + 1} as depth from h{s} h join lk on src = url where position <= {most} and not exists (select 1 from q{s} q where q.seed = h.seed and q.url = dst) group by 1, 2"
        if cap_queue:
            fresh = f"select seed, url, ord, depth from (select f.*, row_number() over (partition by f.seed order by ord, url) + held as n from ({fresh}) f join (select seed, count(*) as held from q{s} group by 1) c on c.seed = f.seed) where n <= {most}"
        sql += f""", h{s} as (select q.seed, q.url, q.depth, row_number() over (partition by q.seed order by ord, q.url) + coalesce(n, 0) as position from q{s} q left join (select seed, count(*) as n from {prev} group by 1) c on c.seed = q.seed where q.depth = {s} and q.url % 13 <> 0 and q.url between 1 and (select size from sc)),
 v{s} as (select * from {prev} union all select * from h{s} where position <= {most}),
 q{s + 1} as (select * from q{s} union all {fresh})"""
        prev = f"v{s}"
    return f"{sql} select seed as seed_id, concat('https://h.org/p', url) as url, depth, position from {prev}"


def _reach(spark, sf_dir, most, depth, cap_queue=False):
    parts, suppliers = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    size, m = parts.count(), suppliers.count()
    url = lambda c: F.concat(F.lit("https://h.org/p"), c.cast("string"))
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    start = suppliers.select((s % m).cast("bigint").alias("seed_id"), url(s).alias("url"), s.alias("pos"))
    # answers: every thirteenth is an error
    answers = parts.select(url(p).alias("url"), F.when(p % 13 == 0, 404).otherwise(200).alias("status"), F.lit("text/html; charset=utf-8").alias("content_type"))
    src = F.col("l_orderkey") % size + 1
    pos = F.col("l_linenumber").cast("bigint") * 10_000_000 + F.col("l_partkey")
    links = table(spark, sf_dir, "lineitem").groupBy(src.alias("src"), (F.floor(F.col("l_partkey") / m) * m + src % m).alias("dst")).agg(F.min(pos).alias("pos"))
    links = links.select((F.col("src") % m).cast("bigint").alias("seed_id"), url(F.col("src")).alias("url"), url(F.col("dst")).alias("target"), "pos").filter(frontier.followable(F.col("target")))
    return frontier.reach(start, pages.fetchable(answers), links, most, depth, cap_queue).select("seed_id", "url", "depth", "position")


@query(_reached(12, 3))
def crawl_reachability(spark, sf_dir):
    """Pages reached from each seed's own within depth and number."""
    return _reach(spark, sf_dir, 12, 2)


@query(_reached(10, 10, True))
def sitemap_closure(spark, sf_dir):
    """Documents reached from each seed's own within the number that may be queued."""
    return _reach(spark, sf_dir, 10, None, True)


@query(f"with {OUTCOMES} select seed_id, string_agg(distinct root, ',' order by root) as accepted from oc where collect and root in (select concat('root', s_nationkey * 3 % 97, '.com') from supplier) group by seed_id")
def accepted_roots(spark, sf_dir):
    """Roots of each seed that were collected and are known."""
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("root"), (F.col("s_nationkey") * 3 % 97).cast("string"), F.lit(".com")).alias("root")).distinct()
    return frontier.accepted_roots(ad.outcomes(spark, sf_dir), known)


@query(f"""with dc as ({ORACLE_SQL['discarded_candidates']}), ar as ({ORACLE_SQL['accepted_roots']}), f as (select concat('root', p_partkey % 60, '.com') as root, count(*) as assets from part group by 1),
 d as (select seed_id, root, case when explicit % 3 <> 0 then explicit % 2 = 0 end as collect, implicit / 4.0 as confidence from dc)
 select dc.seed_id, dc.root, concat_ws('; ', case when collectors <> '' then concat('Collectors: ', collectors) end, case when assets is not null then concat('Observed assets: ', assets) end, case when accepted is not null then concat('Accepted roots: ', accepted) end) as evidence,
 coalesce(collect and confidence >= 0.5, false) as promoted, case when coalesce(collect and confidence >= 0.5, false) then 'reconsidered' end as tag from dc left join f on f.root = dc.root left join ar on ar.seed_id = dc.seed_id left join d on d.seed_id = dc.seed_id and d.root = dc.root""")
def reconsider_discards(spark, sf_dir):
    """Discarded candidates looked at again."""
    dc = base.discarded_candidates(spark, sf_dir)
    facts = table(spark, sf_dir, "part").groupBy(F.concat(F.lit("root"), (F.col("p_partkey") % 60).cast("string"), F.lit(".com")).alias("root")).agg(F.count("*").alias("assets"))
    decisions = dc.select("seed_id", "root", F.when(F.col("explicit") % 3 != 0, F.col("explicit") % 2 == 0).alias("collect"), (F.col("implicit") / 4.0).alias("confidence"))
    return frontier.reconsider(dc, facts, accepted_roots(spark, sf_dir), decisions)


@query(f"""with rq as ({ORACLE_SQL['review_queue']}), q as (select opened_by as run_id, root, status from rq), d as (select concat('root', s_nationkey * 3 % 97, '.com') as root, bool_or(s_nationkey % 2 = 0) as collect from supplier group by 1),
 r as (select run_id, q.root, case when status <> 'pending_review' then status when collect then 'scheduled' when not collect then 'rejected' else 'pending_review' end as state from q left join d on d.root = q.root) select *, bool_or(state = 'pending_review') over (partition by run_id) as blocked from r""")
def review_resume(spark, sf_dir):
    """Reviews after decisions, and whether their run still waits."""
    k = F.col("s_nationkey")
    d = table(spark, sf_dir, "supplier").groupBy(F.concat(F.lit("root"), (k * 3 % 97).cast("string"), F.lit(".com")).alias("root")).agg(F.bool_or(k % 2 == 0).alias("collect"))
    return frontier.resume_reviews(base.review_queue(spark, sf_dir).select(F.col("opened_by").alias("run_id"), "root", "status"), d)


STAGES = "st as (select distinct type, asset_key, source as stage, case when seq % 2 = 0 then 'cached' else 'completed' end as status, seen_us as updated_us from o where kind = 'enrichment')"
IDS = f"with {CANONICAL}, {enriched.ENUMS}, {enriched.PROV}, ids as (select type, asset_key, asset_id, ownership_state, root from rooted), ob as (select ids.asset_id, o.id, o.source, o.identifier, o.kind from o join ids on o.type = ids.type and o.asset_key = ids.asset_key)"


def _ids(spark, sf_dir):
    return keys.attach_root(stored(fold.asset_ids(ad.observations(spark, sf_dir)), "ids"), "asset_key", base._rules(spark)).select("type", "asset_key", "asset_id", "ownership_state", "root")


@query(f"""{IDS}, sg as (select asset_id, coalesce(seed_id, '') as seed_id, coalesce(company_name, '') as label, count(*) as n from pv join ids on pv.type = ids.type and pv.asset_key = ids.asset_key left join en on en.id = pv.enumeration_id group by all),
 rl as (select asset_id, concat('rel-', asset_id) as id, 'same_root' as kind, root as peer from ids where root <> asset_key), es as (select asset_id, o.source as stage, 'completed' as status from o join ids on o.type = ids.type and o.asset_key = ids.asset_key where kind = 'enrichment' group by all),
 grp as (select asset_id, 'observations' as g, 'Observations' as t, concat(count(*), ' supporting observations') as s from ob group by 1 union all select asset_id, 'seeds', 'Seed Context', concat(count(*), ' contributing seeds') from sg group by 1 union all select asset_id, 'relations', 'Relations', concat(count(*), ' linked discovery edges') from rl group by 1 union all select distinct asset_id, 'enrichment', 'Enrichment', 'Runtime cache and enrichment results' from es)
 select asset_id, concat('asset:', asset_id) as id, null as parent_id, 'asset' as kind, asset_key as label, type as subtitle, ownership_state as badges from ids
 union all select asset_id, concat('asset:', asset_id, ':', g), concat('asset:', asset_id), 'group', t, s, '' from grp
 union all select asset_id, concat('obs:', id), concat('asset:', asset_id, ':observations'), 'observation', source, identifier, concat(upper(kind[1]), kind[2:]) from ob
 union all select asset_id, concat('seed:', seed_id), concat('asset:', asset_id, ':seeds'), 'seed', label, seed_id, concat(n, ' contributors') from sg
 union all select asset_id, concat('rel:', id), concat('asset:', asset_id, ':relations'), 'relation', kind, peer, kind from rl
 union all select asset_id, concat('enrich:', asset_id, ':', stage), concat('asset:', asset_id, ':enrichment'), 'enrichment', stage, status, '' from es""")
def trace_nodes(spark, sf_dir):
    """The tree of each asset as rows."""
    return trees.nodes(_tree_tables(spark, sf_dir))


def _tree_tables(spark, sf_dir):
    obs = ad.observations(spark, sf_dir).withColumn("asset_key", keys.asset_key(F.col("identifier")))
    return trees.tree_tables(_ids(spark, sf_dir), obs, enriched._enumerations(spark, sf_dir), ad.seeds(spark, sf_dir))


def _lines(rows: str, told: dict[str, list[tuple[str, str]]]) -> str:
    """SQL of the lines of one kind of nodes: ``rows`` gives asset_id, node and the columns that lines name."""
    out = []
    for title, xs in told.items():
        items = ", ".join(f"case when coalesce(trim({c}::varchar), '') <> '' then concat('{text}: ', {c}::varchar) end" for text, c in xs)
        out.append(f"select asset_id, node as id, '{title}' as title, unnest(range(len(i)))::int as position, unnest(i) as item from (select asset_id, node, list_filter([{items}], lambda x: x is not null) as i from ({rows}))")
    return " union all ".join(out)


_DAY = "strftime(make_timestamp({c}), '%Y-%m-%d %H:%M:%S')"
_DETAILS = " union all ".join([
    _lines("select ids.asset_id, concat('obs:', o.id) as node, o.*, en.id as eid, en.seed_id as sid, coalesce(company_name, '') as label, case when en.id is not null then sd.domain end as dom from o join ids on o.type = ids.type and o.asset_key = ids.asset_key left join en on en.id = o.enumeration_id left join (select id as sd_id, domain from sd) sd on sd_id = en.seed_id",
           {"Observation": [("Observation ID", "id"), ("Kind", "kind"), ("Type", "type"), ("Identifier", "identifier"), ("Source", "source"), ("Discovered at", _DAY.format(c="seen_us")), ("Ownership state", "ownership_state"), ("Inclusion reason", "inclusion_reason")],
            "Enumeration": [("Enumeration ID", "eid"), ("Seed ID", "sid")], "Seed Context": [("Seed ID", "sid"), ("Company", "label"), ("Seed domains", "dom")]}),
    _lines("select asset_id, concat('seed:', coalesce(seed_id, ''), ':contributor:', row_number() over (partition by asset_id, coalesce(seed_id, '') order by seen_us, enumeration_id, source) - 1) as node, source, enumeration_id, seen_us from pv join ids on pv.type = ids.type and pv.asset_key = ids.asset_key left join en on en.id = enumeration_id",
           {"Contributor": [("Source", "source"), ("Enumeration ID", "enumeration_id"), ("Originating asset ID", "asset_id"), ("Discovered at", _DAY.format(c="seen_us"))]}),
    _lines("select asset_id, concat('rel:rel-', asset_id) as node, root, asset_key from ids where root <> asset_key", {"Relation": [("Kind", "'same_root'")], "Endpoints": [("From", "asset_key"), ("To", "root")]}),
    _lines("select distinct asset_id, concat('enrich:', asset_id, ':', source) as node, source from ob where kind = 'enrichment'", {"Enrichment State": [("Stage", "source"), ("Status", "'completed'")]}),
    _lines("select asset_id, concat('asset:', asset_id, ':observations') as node, count(*) as n, count(*) filter (where kind <> 'enrichment') as found, string_agg(distinct source, ', ' order by source) as sources, string_agg(distinct enumeration_id, ', ' order by enumeration_id) as enums, min(seen_us) as f, max(seen_us) as l from o join ids on o.type = ids.type and o.asset_key = ids.asset_key group by asset_id",
           {"Observation Summary": [("Total observations", "n"), ("Discovery observations", "found"), ("Enrichment observations", "(n - found)"), ("Sources", "sources"), ("Enumerations", "enums"), ("First seen", _DAY.format(c="f")), ("Last seen", _DAY.format(c="l"))]}),
])


@query(f"{IDS}, {SEEDS} {_DETAILS}")
def trace_details(spark, sf_dir):
    """The lines that nodes of each asset's tree tell."""
    return trees.details(_tree_tables(spark, sf_dir))


@query(f"""with ar as ({ORACLE_SQL['asset_rows']}), i as (select asset_id, unnest([{', '.join(f"{{'title': '{t}', 'k': {n}, 'item': case when {c} <> '' then concat('{x}: ', {c}) end}}" for n, (t, x, c) in enumerate([('Result', 'Asset ID', 'asset_id'), ('Result', 'Asset type', 'type'), ('Result', 'Contributors', 'all_sources'), ('Result', 'Discovered by', 'discovery_sources'), ('Result', 'Enriched by', 'enrichment_sources'), ('Ownership', 'Ownership state', 'ownership_state'), ('Ownership', 'Inclusion reason', 'inclusion_reason')]))}]) as s from ar)
 select asset_id, s.title as title, (row_number() over (partition by asset_id, s.title order by s.k) - 1)::int as position, s.item as item from i where s.item is not null""")
def trace_sections(spark, sf_dir):
    """Evidence lines of each asset."""
    return readmodel.trace_sections(reports.asset_rows(spark, sf_dir))


@query(f"with {OBSERVATIONS}, {STAGES}, c as (select type || '|' || asset_key as asset_id, status, count(*) as n, max(updated_us) as late from st group by 1, 2), s as (select type || '|' || asset_key as asset_id, string_agg(distinct stage, ',' order by stage) as stages from st group by 1) select c.asset_id, stages, string_agg(concat(status, ' (', n, ')'), ', ' order by status) as statuses, max(late) as latest_us from c join s on s.asset_id = c.asset_id group by 1, 2")
def enrichment_summary(spark, sf_dir):
    """Stages and statuses of each asset's enrichment."""
    obs = ad.observations(spark, sf_dir).filter("kind = 'enrichment'")
    rows = obs.select(F.concat_ws("|", "type", keys.asset_key(F.col("identifier"))).alias("asset_id"), F.col("source").alias("stage"), F.when(F.col("seq") % 2 == 0, "cached").otherwise("completed").alias("status"), F.col("seen_us").alias("updated_us")).distinct()
    return readmodel.enrichment_summary(rows)


@query(f"with {OUTCOMES} select split_part(root, '.', 1) as label, string_agg(distinct root, ',' order by root) as roots from (select root from oc union all select replace(root, '.com', '.net') from oc where collect) group by 1")
def roots_by_label(spark, sf_dir):
    """Roots by their label."""
    oc = ad.outcomes(spark, sf_dir)
    return readmodel.roots_by_label(oc.select("root").union(oc.filter("collect").select(F.regexp_replace("root", r"\.com$", ".net"))))


@query(f"with r as ({ORACLE_SQL['outbound_roots']}) select seed_id, root, links, referrers, row_number() over (partition by seed_id order by links desc, referrers desc, root) as rank from r")
def rank_candidates(spark, sf_dir):
    """Candidates of each seed, ranked."""
    return readmodel.rank_candidates(reports.outbound_roots(spark, sf_dir).select("seed_id", "root", "links", "referrers"))


@query("select coalesce(n.k, e.k) as k, coalesce(n.v, e.v) as v from (select o_orderkey as k, o_orderstatus as v from orders) e full join (select l_partkey as k, concat('new ', max(l_returnflag)) as v from lineitem group by 1) n on n.k = e.k")
def upsert_read_model(spark, sf_dir):
    """A read model's version after an upsert, saved as a snapshot and loaded again."""
    o, path = table(spark, sf_dir, "orders"), folder(spark)
    k = F.col("o_orderkey").alias("k")
    existing = o.select(k, F.col("o_orderstatus").alias("v"))
    snapshots.save_snapshot(spark, path, 1, {"model": existing})
    now = readmodel.upsert(snapshots.load_snapshot(spark, path)["model"], table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.concat(F.lit("new "), F.max("l_returnflag")).alias("v")), "k")
    snapshots.save_snapshot(spark, path, 2, {"model": now})
    return snapshots.load_snapshot(spark, path)["model"]


@query(f"with {CANONICAL} select asset_id, type, asset_key as identifier, root, case when type = 'ip' then 'ip' when root = asset_key then 'registrable' else 'subdomain' end as domain_kind, ownership_state from rooted")
def export_json(spark, sf_dir):
    """Assets written as JSON lines, read back."""
    kind = F.when(F.col("type") == "ip", "ip").when(F.col("root") == F.col("asset_key"), "registrable").otherwise("subdomain")
    rows, path = _ids(spark, sf_dir).select("asset_id", "type", F.col("asset_key").alias("identifier"), "root", kind.alias("domain_kind"), "ownership_state"), folder(spark)
    rows.write.option("ignoreNullFields", False).json(path)
    return spark.read.schema(rows.schema).json(path)


def _exports(spark, sf_dir):
    kind = F.when(F.col("type") == "ip", "ip").when(F.col("root") == F.col("asset_key"), "registrable").otherwise("subdomain")
    rooted = base._rooted(spark, sf_dir)
    assets = rooted.select("asset_id", kind.alias("domain_kind"), "root", "asset_key", "sources", F.date_format(F.timestamp_micros("first_seen_us"), "yyyy-MM-dd HH:mm:ss").alias("date"))
    obs = ad.observations(spark, sf_dir).select(keys.asset_key(F.col("identifier")).alias("asset_key"), F.when(F.col("seq") % 2 == 0, "a").otherwise("txt").alias("record_type"), F.concat(F.lit("v"), (F.col("seq") % 5).cast("string")).alias("value"))
    n = table(spark, sf_dir, "nation")
    reg = n.select(F.concat(F.lit("org"), F.col("n_nationkey").cast("string"), F.lit(".com")).alias("domain"), F.col("n_name").alias("registrar_name"), F.lit("2020-01-02").cast("timestamp").alias("created"), F.lit(None).cast("timestamp").alias("updated"), F.lit(None).cast("timestamp").alias("expires"), F.lit("Org").alias("registrant_org"), F.array(F.lit("ns1.x.com"), F.lit("ns2.x.com")).alias("name_servers"))
    org = n.select(F.concat(F.lit("203.0.113."), F.col("n_nationkey").cast("string")).alias("ip"), F.col("n_nationkey").alias("asn"), F.col("n_name").alias("organization"), F.lit("ptr").alias("ptr"), F.lit("203.0.113.0/24").alias("cidr"))
    return snapshots.export_tables(assets, obs, reg, org)


DATED = "strftime(make_timestamp(first_seen_us), '%Y-%m-%d %H:%M:%S') as date"


@query(f"with {CANONICAL} select asset_id, asset_key as registrable_domain, sources, {DATED}, coalesce(n_name, '') as registrar, case when n_name is null then '' else '2020-01-02' end as created, '' as updated, '' as expires, case when n_name is null then '' else 'Org' end as registrant_org, case when n_name is null then '' else 'ns1.x.com, ns2.x.com' end as nameservers from rooted left join nation on asset_key = concat('org', n_nationkey, '.com') where type = 'domain' and root = asset_key")
def export_registrable(spark, sf_dir):
    """Export table of registrable domains."""
    return _exports(spark, sf_dir)["registrable_domains"]


@query(f"with {CANONICAL}, l as (select asset_key, coalesce(string_agg(distinct concat('v', seq % 5), ', ' order by concat('v', seq % 5)) filter (where seq % 2 = 0), '') as a, coalesce(string_agg(distinct concat('v', seq % 5), ', ' order by concat('v', seq % 5)) filter (where seq % 2 = 1), '') as txt from o group by 1) select asset_id, root as registrable_domain, rooted.asset_key as hostname, sources, {DATED}, a, '' as aaaa, '' as cname, '' as mx, txt from rooted join l on l.asset_key = rooted.asset_key where type = 'domain' and root <> rooted.asset_key")
def export_subdomains(spark, sf_dir):
    """Export table of other hosts."""
    return _exports(spark, sf_dir)["subdomains"]


@query(f"with {CANONICAL} select asset_id, asset_key as ip, sources, {DATED}, n_nationkey as asn, n_name as organization, case when n_name is not null then 'ptr' end as ptr, case when n_name is not null then '203.0.113.0/24' end as cidr from rooted left join nation on asset_key = concat('203.0.113.', n_nationkey) where type = 'ip'")
def export_ips(spark, sf_dir):
    """Export table of addresses."""
    return _exports(spark, sf_dir)["ips"]


@query("select concat('u', user_id) as seed_key from events group by 1 having max(value) filter (where trim(event_type) <> '') >= 90 or count(distinct case when trim(event_type) <> '' then concat(event_type, '|', event_id % 2) end) >= 2")
def candidate_state(spark, sf_dir):
    """Candidates promoted by streamed evidence."""
    path, out = f"{sf_dir}/events.parquet", folder(spark)
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*events.parquet").parquet(sf_dir)
    told = events.select(F.concat(F.lit("u"), ad.text("user_id")).alias("seed_key"), F.trim("event_type").alias("source"), (F.col("event_id") % 2).cast("string").alias("kind"), (F.col("value") / 100).alias("confidence"), F.lit(False).alias("reasoned"))
    return candidates.promoted_candidates(spark, told, f"{out}/promoted", f"{out}/progress").select("seed_key")


@query(f"with {OBSERVATIONS}, {RELATIONS}, {OUTCOMES} select 'assets' as metric, count(distinct type || '|' || asset_key) as n from o union all select 'seeds', count(*) from customer union all select 'relations', count(*) from rel union all select 'accepted', count(*) from oc where collect union all select 'discarded', count(*) from oc where not collect")
def run_metrics(spark, sf_dir):
    """Counts of a run, one row each."""
    obs = ad.observations(spark, sf_dir).select(F.concat_ws("|", "type", keys.asset_key(F.col("identifier"))).alias("k")).distinct()
    judged_rows = ad.outcomes(spark, sf_dir).groupBy("collect").agg(F.count("*").alias("n")).select(F.when(F.col("collect"), "accepted").otherwise("discarded").alias("metric"), "n")
    count = lambda rows, name: rows.agg(F.lit(name).alias("metric"), F.count("*").alias("n"))
    return count(obs, "assets").union(count(table(spark, sf_dir, "customer"), "seeds")).union(count(ad.relations(spark, sf_dir), "relations")).union(judged_rows)


@query(f"with {OUTCOMES} select seed_id, collector as source, count(*) as judged, count(*) filter (where collect) as accepted, count(*) filter (where collect and confidence < 0.5) as low_confidence, coalesce(string_agg(distinct root, ',' order by root) filter (where collect and confidence >= 0.5), '') as promoted_roots from oc group by 1, 2")
def collector_stats(spark, sf_dir):
    """Judged, accepted and promoted candidates of each seed and source."""
    low = F.col("collect") & (F.col("confidence") < 0.5)
    return ad.outcomes(spark, sf_dir).groupBy("seed_id", F.col("collector").alias("source")).agg(F.count("*").alias("judged"), F.count_if("collect").alias("accepted"), F.count_if(low).alias("low_confidence"), F.array_join(F.array_sort(F.collect_set(F.when(judged.confidence_gate(F.col("collect"), F.col("confidence")), F.col("root")))), ",").alias("promoted_roots"))


@query(f"with {RELATIONS} select 'dangling_to' as issue, count(*) as n from rel where lower(to_identifier) not in (select lower(identifier) from ga) union all select 'dangling_from', count(*) from rel where lower(from_identifier) not in (select lower(identifier) from ga) union all select 'repeated', (select count(*) from rel) - (select count(*) from (select distinct from_identifier, to_identifier, kind from rel))")
def graph_validation(spark, sf_dir):
    """Counts of edges without an end, and of repeated ones."""
    rel, ids = ad.relations(spark, sf_dir), ad.graph_assets(spark, sf_dir).select(keys.asset_key(F.col("identifier")).alias("k")).distinct()
    miss = lambda end: rel.join(ids, keys.asset_key(F.col(f"{end}_identifier")) == F.col("k"), "left_anti").agg(F.lit(f"dangling_{end}").alias("issue"), F.count("*").alias("n"))
    repeats = rel.groupBy("from_identifier", "to_identifier", "kind").agg((F.count("*") - 1).alias("n")).agg(F.lit("repeated").alias("issue"), F.sum("n").alias("n"))
    return miss("to").union(miss("from")).union(repeats)
