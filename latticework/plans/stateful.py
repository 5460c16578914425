"""Queries that keep state: stored and streamed folds, waves that resume, reviews that wait, sets replaced by key."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from latticework.functions import keys
from latticework.operators import crawl, enrich, exclusions, judged
from latticework.operators.enrich import SHARED_ROOTS
from latticework.operators.stored_fold import AssetStore
from latticework.operators.waves import Waves
from latticework.session import folder, stored
from latticework.sources.keyed import KeyedTable
from latticework.streaming import live_fold as live
from latticework.streaming.reviews import review_states

from . import adapters as ad
from . import expanded, queries
from .adapters import OBSERVATIONS, OUTCOMES, table
from .expanded import EVIDENCE
from .queries import ORACLE_SQL, query


def _events(spark, sf_dir):
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*events.parquet").parquet(sf_dir)


@query(ORACLE_SQL["canonical_assets"])
def live_fold(spark, sf_dir):
    """Sightings streamed into the whole fold, whose states stay in a state store."""
    at = folder(spark)
    return live.live_fold(spark, ad.observations_of(_events(spark, sf_dir)), f"{at}/live", f"{at}/progress")


@query(ORACLE_SQL["canonical_assets"])
def stored_fold(spark, sf_dir):
    """Sightings folded into stored assets in three batches."""
    store, obs = AssetStore(spark, folder(spark)), ad.observations(spark, sf_dir)
    for batch in range(3):
        store.add(obs.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == batch), batch)
    return store.assets()


@query("select l_orderkey as k, count(*) as n, max(l_shipdate)::date as last from lineitem where l_returnflag <> 'N' group by 1")
def replaced_sets(spark, sf_dir):
    """A stored set replaced by another: equal rows stay untouched, missing ones get tombstones."""
    lines, out = table(spark, sf_dir, "lineitem"), KeyedTable(spark, folder(spark), "k bigint, n bigint, last date", ["k"])
    sets = [lines.groupBy(F.col("l_orderkey").cast("bigint").alias("k")).agg(F.count_if(keep).alias("n"), F.max(F.when(keep, F.to_date("l_shipdate"))).alias("last")).filter("n > 0") for keep in (F.col("l_returnflag") != "R", F.col("l_returnflag") != "N")]
    for wanted in sets:
        out.replace_set(wanted)
    return out.read()


def _bounded(waves: int = 3) -> str:
    """Waves over the line items' evidence, reconsideration by parts' decisions, one extra wave."""
    sql = f"with {EVIDENCE}, n as (select count(*) * 64 as size from supplier), k0 as (select concat('k', s_suppkey) as seed_key, 0 as wave, 'given' as how from supplier), t0 as (select * from ev where false)"
    for w in range(1, waves + 1):
        sql += f""", t{w} as (select * from t{w - 1} union all select * from ev where parent_key in (select seed_key from k{w - 1} where wave = {w - 1})),
 k{w} as (select * from k{w - 1} union all select seed_key, {w}, 'promoted' from t{w} where seed_key not in (select seed_key from k{w - 1}) group by seed_key having bool_or(reasoned) or max(confidence) >= 0.9 or count(distinct concat(source, '|', kind)) >= 2)"""
    return f"""{sql}, again as (select distinct seed_key from t{waves} where seed_key not in (select seed_key from k{waves}) and seed_key in (select concat('k', p_partkey % size + 1) from part, n group by 1 having bool_or(p_size > 25))),
 kx as (select * from k{waves} union all select seed_key, (select max(wave) + 1 from k{waves}), 'reconsidered' from again),
 tx as (select distinct seed_key from ev where parent_key in (select seed_key from again) and seed_key not in (select seed_key from kx))
 select * from kx union all select seed_key, (select max(wave) + 2 from k{waves}), 'registered' from tx"""


def _run(spark, sf_dir, path):
    seeds = table(spark, sf_dir, "supplier").select(F.concat(F.lit("k"), ad.text("s_suppkey")).alias("seed_key"))
    return Waves(spark, path).start(seeds, expanded._evidence(spark, sf_dir))


def _again(spark, sf_dir):
    size = table(spark, sf_dir, "supplier").count() * 64
    decisions = table(spark, sf_dir, "part").groupBy(F.concat(F.lit("k"), (F.col("p_partkey") % size + 1).cast("string")).alias("seed_key")).agg(F.bool_or(F.col("p_size") > 25).alias("collect"))
    return lambda run: run.discarded().join(decisions.filter("collect"), "seed_key", "left_semi").select("seed_key", F.lit("reconsideration").alias("source"), F.lit("decision").alias("kind"), F.lit(1.0).alias("confidence"), F.lit(True).alias("reasoned"))


@query(_bounded())
def expand_waves(spark, sf_dir):
    """Seeds by the wave they came in, with reconsidered ones and those that their extra wave registers; each step by another object that resumes the run."""
    path = folder(spark)
    run = _run(spark, sf_dir, path)
    while run.step(None, _again(spark, sf_dir)):
        run = Waves(spark, path)
    return run.known()


@query(f"""with rq as ({ORACLE_SQL['review_queue']}), r as (select opened_by as run_id, root, status, 700000000000000 + opened_seq % 200000000 * 1000000 as us from rq),
 d as (select o_orderpriority as run_id, concat('root', o_custkey % 1997, '.com') as root, o_totalprice > 150000 as collect, epoch_us(o_orderdate::timestamp) as us from orders where o_orderstatus = 'P'),
 l as (select run_id, root, arg_max(collect, us * 2 + collect::int) as collect from d group by 1, 2), wm as (select least((select max(us) from r), (select max(us) from d)) as us),
 s as (select r.run_id, r.root, case when status <> 'pending_review' then status when collect then 'scheduled' when not collect then 'rejected' when r.us + 365 * 86400000000 <= wm.us then 'overdue' else status end as state, r.us as opened_us from r cross join wm left join l on l.run_id = r.run_id and l.root = r.root)
 select *, bool_or(state in ('pending_review', 'overdue')) over (partition by run_id) as blocked from s""")
def review_stream(spark, sf_dir):
    """Reviews and decisions as two streams: each review's state, and whether its run waits."""
    at, o = folder(spark), table(spark, sf_dir, "orders")
    queue = queries.review_queue(spark, sf_dir)
    queue.select(F.col("opened_by").alias("run_id"), "root", "status", F.timestamp_micros(700000000000000 + F.col("opened_seq") % 200000000 * 1000000).alias("at")).write.parquet(f"{at}/reviews")
    root = F.concat(F.lit("root"), (F.col("o_custkey") % 1997).cast("string"), F.lit(".com"))
    o.filter("o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("run_id"), root.alias("root"), (F.col("o_totalprice") > 150000).alias("collect"), F.col("o_orderdate").cast("timestamp").alias("at")).write.parquet(f"{at}/decisions")
    streams = [spark.readStream.schema(spark.read.parquet(f"{at}/{name}").schema).parquet(f"{at}/{name}") for name in ("reviews", "decisions")]
    return review_states(spark, *streams, f"{at}/states", f"{at}/progress", timedelta(days=365))


#: Captured pages are parts, seeds suppliers: a part's page is on one of three hosts of the seed that its remainder names. Some answers are errors, some redirect: to themselves, out of the
#: scope, or along parts of the same seed. Links come from line items.
_U = "concat('https://', case when {p} % 3 = 0 then '' else concat('w', {p} % 3, '.') end, 'org', {p} % m, '.com/p', {p})"
_X = "concat('https://x', {p} % 2, '.away', {p} % 5, '.net/p', {p})"
_SITE = f"""sc as (select (select count(*) from supplier) as m, (select count(*) from part) as size),
an as (select {_U.format(p='p_partkey')} as url, case when p_partkey % 13 = 0 or p_partkey % 5 <> 1 then null when p_partkey % 7 = 0 then {_U.format(p='p_partkey')} when p_partkey % 11 = 0 then {_X.format(p='p_partkey')}
 when p_partkey % 3 = 0 and p_partkey > m then {_U.format(p='(p_partkey - m)')} when p_partkey + m <= size then {_U.format(p='(p_partkey + m)')} end as target, p_partkey % 13 <> 0 as page from part, sc
 union all select distinct {_X.format(p='p_partkey')}, null, true from part, sc),
li as (select {_U.format(p='(l_orderkey % size + 1)')} as url, case l_linenumber when 1 then {_U.format(p='l_partkey')} when 2 then {_X.format(p='l_partkey')} else {_U.format(p='(l_partkey // m * m + (l_orderkey % size + 1) % m)')} end as target, l_linenumber * 10000000 + l_partkey as pos, lower(l_returnflag) as relation from lineitem, sc),
lk as (select url, target, min(pos) as pos, arg_min(relation, (pos, relation)) as relation from li group by 1, 2)"""
_HOST = "split_part({u}, '/', 3)"
_ROOT = "regexp_extract(split_part({u}, '/', 3), '([^.]+\\.[^.]+)$', 1)"


def _crawled(most: int = 12, depth: int = 2) -> str:
    sql = f"""with recursive {_SITE}, hop as (select url, url as at, 0 as n from an union all select hop.url, an.target, n + 1 from hop join an on an.url = hop.at where an.target is not null and n <= 10),
 fe as (select hop.url, hop.at as final_url from hop join an on an.url = hop.at where an.target is null and an.page and n <= 10),
 q0 as (select s_suppkey % m as seed, {_U.format(p='s_suppkey')} as url, s_suppkey as ord, 0 as depth from supplier, sc), v as (select 0 as seed, '' as url, 0 as depth, 0::bigint as position where false)"""
    prev = "v"
    for s in range(depth + 1):
        sql += f""", h{s} as (select q.seed, q.url, q.depth, row_number() over (partition by q.seed order by ord, q.url) + coalesce(n, 0) as position from q{s} q join fe on fe.url = q.url left join (select seed, count(*) as n from {prev} group by 1) c on c.seed = q.seed where q.depth = {s}),
 v{s} as (select * from {prev} union all select * from h{s} where position <= {most}),
 q{s + 1} as (select * from q{s} union all select h.seed, lk.target, min(h.position * 100000000000 + lk.pos), {s + 1} from h{s} h join fe on fe.url = h.url join lk on lk.url = fe.final_url
  where position <= {most} and {_ROOT.format(u='fe.final_url')} = concat('org', h.seed, '.com') and {_ROOT.format(u='lk.target')} = concat('org', h.seed, '.com') and not exists (select 1 from q{s} q where q.seed = h.seed and q.url = lk.target) group by 1, 2)"""
        prev = f"v{s}"
    return f"{sql}, pg as (select v.seed, v.url, final_url, depth, position, {_ROOT.format(u='final_url')} = concat('org', seed, '.com') as inside from {prev} v join fe on fe.url = v.url), en as (select distinct seed, final_url from pg where inside)"


def _crawl(spark, sf_dir):
    parts, lines, suppliers = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    m, size = suppliers.count(), parts.count()
    text, p, n = (lambda c: c.cast("string")), F.col("p_partkey"), F.col("l_partkey")
    u = lambda c: F.concat(F.lit("https://"), F.when(c % 3 == 0, "").otherwise(F.concat(F.lit("w"), text(c % 3), F.lit("."))), F.lit("org"), text(c % m), F.lit(".com/p"), text(c))
    x = lambda c: F.concat(F.lit("https://x"), text(c % 2), F.lit(".away"), text(c % 5), F.lit(".net/p"), text(c))
    target = F.when((p % 13 != 0) & (p % 5 == 1), F.when(p % 7 == 0, u(p)).when(p % 11 == 0, x(p)).when((p % 3 == 0) & (p > m), u(p - m)).when(p + m <= size, u(p + m)))
    answers = parts.select(u(p).alias("url"), target.alias("target"), (p % 13 != 0).alias("page")).union(parts.select(x(p), F.lit(None).cast("string"), F.lit(True)).distinct())
    src = F.col("l_orderkey") % size + 1
    links = lines.select(u(src).alias("url"), F.when(F.col("l_linenumber") == 1, u(n)).when(F.col("l_linenumber") == 2, x(n)).otherwise(u((F.floor(n / m) * m + src % m).cast("bigint"))).alias("target"), (F.col("l_linenumber").cast("bigint") * 10_000_000 + n).alias("pos"), F.lower("l_returnflag").alias("relation"))
    links = links.groupBy("url", "target").agg(F.min("pos").alias("pos"), F.min_by("relation", F.struct("pos", "relation")).alias("relation"))
    links = stored(links, "links")  # read for the hosts and with them
    fetched = stored(crawl.fetched_pages(answers), "fetched")
    urls = fetched.select(F.col("final_url").alias("url")).union(links.select("target")).distinct()
    hosts = keys.attach_root(urls.withColumn("host", keys.url_host(F.col("url"))), "host", queries._rules(spark))
    seed = (F.col("s_suppkey") % m).cast("bigint")
    scope = suppliers.select(seed.alias("seed_id"), F.concat(F.lit("org"), text(seed), F.lit(".com")).alias("root")).distinct()
    return crawl.crawl(suppliers.select(seed.alias("seed_id"), u(F.col("s_suppkey")).alias("url"), F.col("s_suppkey").alias("pos")), scope, fetched, hosts, links)


@query(f"{_crawled()} select seed as seed_id, url, final_url, depth, position from pg")
def crawl_redirects(spark, sf_dir):
    """Pages reached from each seed, and where their redirects end."""
    return _crawl(spark, sf_dir)["pages"]


@query(f"""{_crawled()} select seed as seed_id, {_HOST.format(u='final_url')} as host from pg where inside and {_HOST.format(u='final_url')} <> {_ROOT.format(u='final_url')}
 union select seed, {_HOST.format(u='target')} from en join lk on lk.url = final_url where {_ROOT.format(u='target')} = concat('org', seed, '.com') and {_HOST.format(u='target')} <> {_ROOT.format(u='target')}""")
def crawl_hosts(spark, sf_dir):
    """Hosts of each seed's scope that its pages end at or link to."""
    return _crawl(spark, sf_dir)["hosts"]


@query(f"""{_crawled()} select seed as seed_id, {_ROOT.format(u='final_url')} as root, url as source_url, final_url as target_url, 'redirect' as relation from pg where not inside
 union all select seed, {_ROOT.format(u='target')}, url, target, relation from en join lk on lk.url = final_url where {_ROOT.format(u='target')} <> concat('org', seed, '.com')""")
def crawl_candidates(spark, sf_dir):
    """Links and redirects that lead out of each seed's scope."""
    return _crawl(spark, sf_dir)["candidates"]


@query(f"""with {OUTCOMES}, c as (select distinct concat('seed-', l_orderkey % 25) as seed_id, case when l_linenumber = 7 then '{SHARED_ROOTS[0]}' else concat('root', (l_suppkey * 3 + l_partkey) % 397, '.com') end as root from lineitem),
 x as (select concat('seed-', s_suppkey % 25) as seed_id, concat('root', s_suppkey % 397, '.com') as root from supplier union select concat('seed-', c_custkey % 25), concat('root', c_custkey * 7 % 397, '.com') from customer where c_acctbal < 0
  union select seed_id, root from oc where confidence >= 0.5)
 select seed_id, root from c where root <> '{SHARED_ROOTS[0]}' and (seed_id, root) not in (select (seed_id, root) from x) and root not in (select concat('root', n_nationkey * 13 % 397, '.com') from nation)""")
def anti_known_all(spark, sf_dir):
    """Candidates that none of five kinds of exclusions names."""
    name = lambda c: F.concat(F.lit("root"), (c % 397).cast("string"), F.lit(".com"))
    seed = lambda c: F.concat(F.lit("seed-"), (F.col(c) % 25).cast("string"))
    lines, s, c = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    root = F.when(F.col("l_linenumber") == 7, SHARED_ROOTS[0]).otherwise(name(F.col("l_suppkey") * 3 + F.col("l_partkey")))
    judged = ad.outcomes(spark, sf_dir).filter("confidence >= 0.5")
    return exclusions.unexcluded(
        lines.select(seed("l_orderkey").alias("seed_id"), root.alias("root")).distinct(), s.select(seed("s_suppkey").alias("seed_id"), name(F.col("s_suppkey")).alias("root")),
        c.filter("c_acctbal < 0").select(seed("c_custkey").alias("seed_id"), name(F.col("c_custkey") * 7).alias("root")), judged.filter("collect"), judged.filter("not collect"),
        table(spark, sf_dir, "nation").select(name(F.col("n_nationkey") * 13).alias("root")), SHARED_ROOTS)


#: Outcomes with the seed's label and domains, a reason and support, both of which come in several spellings or are missing.
_TOLD = f"""{OUTCOMES}, od as (select oc.*, concat('Label ', seed_id) as label, concat(replace(seed_id, 'seed-', 'org'), '.com') as domains, case eval_seq // 200000000 % 4 when 0 then '' when 1 then 'Same registrant' when 2 then 'same Registrant' else concat('Links to ', scenario) end as reason,
 [case when eval_seq // 200000000 % 2 = 0 then concat('Page ', eval_seq // 200000000 % 5) else concat('page ', eval_seq // 200000000 % 5, ' ') end, case when explicit then 'Certificate' else '' end] as support from oc)"""


def _told(spark, sf_dir):
    n, oc = F.floor(F.col("eval_seq") / 200000000), ad.outcomes(spark, sf_dir)
    num = lambda c: c.cast("string")
    page = F.when(n % 2 == 0, F.concat(F.lit("Page "), num(n % 5))).otherwise(F.concat(F.lit("page "), num(n % 5), F.lit(" ")))
    return oc.withColumns({
        "label": F.concat(F.lit("Label "), "seed_id"), "domains": F.concat(F.replace("seed_id", F.lit("seed-"), F.lit("org")), F.lit(".com")),
        "reason": F.when(n % 4 == 0, "").when(n % 4 == 1, "Same registrant").when(n % 4 == 2, "same Registrant").otherwise(F.concat(F.lit("Links to "), "scenario")),
        "support": F.array(page, F.when(F.col("explicit"), "Certificate").otherwise(""))})


@query(f"""with {_TOLD}, g as (select collector, seed_id, label, domains, scenario, root, bool_or(collect) as collect, max(confidence) as confidence, bool_or(explicit) as explicit,
  coalesce(arg_max(kind, eval_seq) filter (where collect and kind <> ''), arg_min(kind, eval_seq) filter (where kind <> '')) as kind, coalesce(arg_max(reason, eval_seq) filter (where collect and reason <> ''), arg_min(reason, eval_seq) filter (where reason <> ''), '') as reason from od group by all),
 s as (select collector, seed_id, label, domains, scenario, root, lower(trim(v)) as low, arg_min(trim(v), (eval_seq, trim(v))) as spelled from (select *, unnest(support) as v from od) where trim(v) <> '' group by all),
 t as (select collector, seed_id, label, domains, scenario, root, string_agg(spelled, ', ' order by spelled) as support from s group by all)
 select g.*, coalesce(t.support, '') as support from g left join t using (collector, seed_id, label, domains, scenario, root)""")
def judged_candidates(spark, sf_dir):
    """Each group's candidates with reason and support."""
    return judged.judged_candidates(_told(spark, sf_dir), ["collector", "seed_id", "label", "domains", "scenario"])


@query(f"""with {_TOLD}, dc as ({ORACLE_SQL['discarded_candidates']}), m as (select od.* from od where not collect and (seed_id, root) in (select (seed_id, root) from dc)),
 v as (select seed_id, root, 'r' as w, eval_seq, 0 as pos, reason as x from m union all select seed_id, root, 's', eval_seq, unnest([0, 1]), unnest(support) from m),
 f as (select seed_id, root, w, lower(trim(x)) as low, arg_min(trim(x), (eval_seq, pos, trim(x))) as spelled, min((eval_seq, pos)) as first from v where trim(x) <> '' group by all)
 select dc.*, coalesce((select string_agg(spelled, '; ' order by first) from f where f.seed_id = dc.seed_id and f.root = dc.root and w = 'r'), '') as reasons, coalesce((select string_agg(spelled, '; ' order by first) from f where f.seed_id = dc.seed_id and f.root = dc.root and w = 's'), '') as support from dc""")
def discarded_details(spark, sf_dir):
    """Discarded candidates with the reasons and support of their outcomes."""
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("root"), (F.col("s_nationkey") * 3 % 97).cast("string"), F.lit(".com")).alias("root")).distinct()
    return judged.discarded_details(_told(spark, sf_dir), known)


@query(f"""with {OBSERVATIONS}, a as (select asset_key as ip, case max(seq) % 5 when 0 then 'completed' when 1 then 'retryable' when 2 then '' end as stage, max(seq) % 5 as m from o where type = 'ip' group by 1),
 p as (select concat('203.0.113.', s_suppkey % 120) as ip, arg_min(concat('h', s_suppkey, '.org', s_nationkey, '.com'), s_suppkey) as ptr from supplier group by 1),
 c as (select distinct concat('203.0.113.', c_nationkey * 8, '/', 29 + c_nationkey % 2) as cidr, (c_nationkey * 8)::int as lo, (c_nationkey * 8 + case when c_nationkey % 2 = 0 then 7 else 3 end)::int as hi, (64500 + c_nationkey)::int as asn, concat('Net ', c_nationkey) as organization from customer
  union all select '203.0.113.0/25', 0, 127, 64000, 'Wide'),
 h as (select a.ip, arg_min((c.cidr, c.asn, c.organization), (c.hi - c.lo, c.cidr)) as o from a join c on a.ip like '203.0.113.%' and split_part(a.ip, '.', 4)::int between lo and hi group by 1),
 r as (select a.*, p.ptr, h.o, m in (1, 2, 3, 4) as ask from a left join p on p.ip = a.ip left join h on h.ip = a.ip)
 select ip, case when ask then ptr end as ptr, case when ask then o[2] end as asn, case when ask then o[3] end as organization, case when ask then o[1] end as cidr, case when not ask then 'cached' when ptr is not null or o is not null then 'completed' else 'retryable' end as stage from r""")
def enrich_ips(spark, sf_dir):
    """Addresses with pointers and origins, where their stage asks for them."""
    text, c, s = (lambda x: x.cast("string")), F.col("c_nationkey"), F.col("s_suppkey")
    late = F.max("seq") % 5
    stage = F.when(late == 0, "completed").when(late == 1, "retryable").when(late == 2, "")
    ips = ad.observations(spark, sf_dir).filter("type = 'ip'").groupBy(keys.asset_key(F.col("identifier")).alias("ip")).agg(stage.alias("stage"))
    pointers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("203.0.113."), text(s % 120)).alias("ip"), F.concat(F.lit("h"), text(s), F.lit(".org"), text(F.col("s_nationkey")), F.lit(".com.")).alias("ptr"), s.alias("pos"))
    origins = table(spark, sf_dir, "customer").select(F.concat(F.lit("203.0.113."), text(c * 8), F.lit("/"), text(29 + c % 2)).alias("cidr"), (64500 + c).cast("int").alias("asn"), F.concat(F.lit("Net "), text(c)).alias("organization")).distinct()
    origins = origins.union(spark.createDataFrame([("203.0.113.0/25", 64000, "Wide")], "cidr string, asn int, organization string"))
    return enrich.enrich_ips(ips, pointers, origins)
