"""The fold of sightings: cases with literal results, in both orders where that must not matter, and against the windowed form."""

import random

import pytest
from pyspark.sql import functions as F

from latticework.operators import fold, frontier, judged, windows
from latticework.operators.stored_fold import SIGHTING

OBS = "seq int, id string, enumeration_id string, type string, identifier string, source string, kind string, ownership_state string, inclusion_reason string, seen_us bigint"


def _fold(spark, rows):
    """rows: (type, identifier, source, kind, state, reason) in order."""
    data = [(i, f"o{i}", "e", t, x, s, k, o, r, 1000 - i) for i, (t, x, s, k, o, r) in enumerate(rows)]
    return {r.asset_key: r for r in fold.canonical_assets(spark.createDataFrame(data, OBS)).collect()}


def test_ownership_rises_in_any_order(spark):
    rows = [("ip", "203.0.113.10", "dns_collector", "discovery", "associated_infrastructure", "Resolved from example.com via DNS"), ("ip", "203.0.113.10", "ip_enricher", "discovery", "uncertain", "PTR is outside the scope")]
    for order in (rows, rows[::-1]):
        got = _fold(spark, order)["203.0.113.10"]
        assert (got.ownership_state, got.inclusion_reason) == ("uncertain", "PTR is outside the scope")


def test_reasons_are_summed_up(spark):
    got = _fold(spark, [("domain", "Gesprobira.cl", "sitemap_collector", "discovery", "owned", ""), ("domain", "gesprobira.CL ", "dns_collector", "discovery", "", "Discovered via dns_collector")])["gesprobira.cl"]
    assert got.inclusion_reason == "Supported by 2 discovery observations from dns_collector, sitemap_collector"
    assert (got.sources, got.asset_id, got.first_seen_us, got.observations) == ("dns_collector, sitemap_collector", "o0", 999, 2)


def test_explicit_reasons_beat_generic_ones(spark):
    rows = [("domain", "a.com", "x", "discovery", "owned", "Discovered via x"), ("domain", "a.com", "y", "discovery", "owned", " Resolved from example.com via DNS ")]
    for order in (rows, rows[::-1]):
        assert _fold(spark, order)["a.com"].inclusion_reason == "Resolved from example.com via DNS"


def test_enrichment_raises_ownership_and_keeps_the_reason(spark):
    got = _fold(spark, [("ip", "203.0.113.10", "dns_collector", "discovery", "", "Resolved from a.com"), ("ip", "203.0.113.10", "ip_enricher", "enrichment", "owned", "PTR within scope")])["203.0.113.10"]
    assert (got.ownership_state, got.inclusion_reason, got.sources) == ("owned", "Resolved from a.com", "dns_collector")


def test_sources_are_split(spark):
    got = _fold(spark, [("domain", "a.com", "CRT.sh, dns_collector", "discovery", "", ""), ("domain", "a.com", " ,dns_collector,", "discovery", "", "")])["a.com"]
    assert got.sources == "crt.sh, dns_collector"


def test_repeated_provenance_counts_once(spark):
    data = [(i, "o", "e", "domain", "a.com", "crt.sh", "discovery", "", "", 5) for i in range(3)]
    got = fold.canonical_assets(spark.createDataFrame(data, OBS)).first()
    assert (got.inclusion_reason, got.observations) == ("Discovered via crt.sh", 3)


def test_fold_equals_its_windowed_form(spark):
    """Reasons by running ownership, observation by observation, on random sightings."""
    rng = random.Random(3)
    rows = [(i, f"o{i}", f"e{i % 4}", rng.choice(["ip", "domain"]), f"k{rng.randrange(60)}", rng.choice("abc"), rng.choice(["discovery", "discovery", "enrichment"]), rng.choice(["", "", "associated_infrastructure", "uncertain", "owned"]), rng.choice(["", "Discovered via a", f"why {i}", f"why {i}"]), i) for i in range(900)]
    got = {(r.type, r.asset_key): (r.ownership_state, r.inclusion_reason) for r in fold.canonical_assets(spark.createDataFrame(rows, OBS)).collect()}
    want = {}
    for key in {(r[3], r[4]) for r in rows}:
        rank, given, found, later = 0, None, [], 0
        own = [r for r in rows if (r[3], r[4]) == key]
        for n, (_, _, _, t, _, source, kind, state, reason, _) in enumerate(own):
            now = fold.STATES.index(state) or (0 if n else {"ip": 1}.get(t, 3))
            if reason.startswith("why") and (kind == "discovery" or not n) and (given is None or now > rank):
                given = reason
            rank, found, later = max(rank, now), found + [source] * (kind == "discovery"), later + (kind == "discovery" and n > 0)
        names = ", ".join(sorted(set(found)))
        derived = f"Discovered via {own[0][5]}" if not later else f"Discovered via {names}" if len(found) == 1 else f"Supported by {len(found)} discovery observations from {names}"
        want[key] = (fold.STATES[rank], given or derived)
    assert got == want


DETAILS = "seq int, type string, identifier string, records array<struct<type:string,value:string>>, is_catch_all boolean, rdap struct<registrant_org:string,name_servers:array<string>>, asn int, organization string, ptr string, data map<string,string>, states map<string,struct<status:string,updated_us:bigint>>"


@pytest.mark.parametrize(("kind", "records", "states", "want"), [
    ("domain", [("A", "203.0.113.10")], None, "resolved"), ("domain", None, {"domain_enricher": ("Completed", 1)}, "unresolved"), ("domain", [], {"domain_enricher": (" retryable", 1)}, "lookup_failed"),
    ("domain", None, {"ip_enricher": ("completed", 1)}, "not_checked"), ("domain", None, None, "not_checked"), ("ip", None, {"domain_enricher": ("completed", 1)}, None),
])
def test_resolution_status(spark, kind, records, states, want):
    df = spark.createDataFrame([(1, kind, "a.com", records, None, None, None, None, None, None, states)], DETAILS)
    got = fold.merged_details(df)
    assert got.select(fold.resolution_status(F.col("type"), F.col("records"), F.col("states")).alias("x")).first().x == want


def test_details(spark):
    rows = [
        (1, "domain", "A.com", [("mx", "Mail.A.com"), ("A", "1.1.1.1")], False, ("", ["ns2.a.com"]), None, None, None, {"k": "1", "cidr": "x"}, {"s": ("cached", 5)}),
        (2, "domain", "a.com ", [("MX", "mail.a.com ")], True, ("Org", ["ns1.a.com", "ns2.a.com"]), None, None, None, {"k": "2"}, {"s": ("failed", 6), "t": ("failed", 1)}),
        (3, "domain", "a.com", None, None, ("Other", None), None, None, None, None, {"s": ("Cached", 7)}),
        (4, "ip", "1.1.1.1", None, None, None, 0, "", None, None, None), (5, "ip", "1.1.1.1", None, None, None, 64500, "Net", "p.a.com", {}, {}), (6, "ip", "1.1.1.1", None, None, None, 7, "No", "q", None, None),
    ]
    got = {r.asset_key: r for r in fold.merged_details(spark.createDataFrame(rows, DETAILS)).collect()}
    a, ip = got["a.com"], got["1.1.1.1"]
    assert [tuple(x) for x in a.records] == [("A", "1.1.1.1"), ("MX", "mail.a.com")] and a.is_catch_all and tuple(a.rdap) == ("Org", ["ns1.a.com", "ns2.a.com"])
    assert a.data == {"k": "2", "cidr": "x"} and {k: tuple(v) for k, v in a.states.items()} == {"s": ("Cached", 7), "t": ("failed", 1)}
    assert (ip.asn, ip.organization, ip.ptr, ip.records, ip.is_catch_all) == (64500, "Net", "p.a.com", [], False)


def test_live_dns(spark):
    df = spark.createDataFrame([(k, [(k, "x")]) for k in ("A", "aaaa", "MX", "NS", "TXT", "CNAME")] + [("none", [])], "k string, records array<struct<type:string,value:string>>")
    assert {r.k for r in df.filter(fold.live_dns(F.col("records"))).collect()} == {"A", "aaaa", "MX", "NS"}


EVIDENCE = "seed_key string, source string, kind string, confidence double, reasoned boolean"


def test_promotion_counts_what_candidates_came_with(spark):
    told = spark.createDataFrame([("weak", "web_hint_collector", "legal_link", 0.72, False), ("two", "web_hint_collector", "legal_link", 0.72, False), ("two", "securitytxt", "securitytxt", 0.62, False), ("own", "a", "b", 0.1, False), ("came", "a", "b", 0.1, False), ("none", "", "", 0.99, False)], EVIDENCE)
    seeds = spark.createDataFrame([("own", 0.95, []), ("came", 0.0, [("c", "d", 0.2, False)]), ("why", 0.0, [("c", "d", 0.2, True)])], f"seed_key string, confidence double, evidence array<struct<{EVIDENCE.split(', ', 1)[1].replace(' ', ':').replace(',:', ',')}>>")
    assert {r.seed_key for r in judged.promote_candidates(told).filter("promoted").collect()} == {"two"}
    assert {r.seed_key for r in judged.promote_candidates(told, seeds).filter("promoted").collect()} == {"two", "own", "came", "why"}


def test_queue_cap(spark):
    """Documents that were never captured use up places in the queue, and only there."""
    start = spark.createDataFrame([("s", "d0", 0)], "seed_id string, url string, pos int")
    links = spark.createDataFrame([("s", "d0", f"d{i}", i) for i in range(1, 20)], "seed_id string, url string, target string, pos int")
    captured = spark.createDataFrame([(f"d{i}",) for i in range(0, 20, 2)], "url string")
    got = lambda cap: sorted((r.position, r.url) for r in frontier.reach(start, captured, links, 6, cap_queue=cap).collect())
    assert got(True) == [(1, "d0"), (2, "d2"), (3, "d4")]
    assert got(False) == [(i + 1, f"d{2 * i}") for i in range(6)]


def test_positions(spark):
    df = spark.range(5000).selectExpr("(id * 7919) % 5000 as k", "cast(id % 7 as string) as g").repartition(5)
    rows = windows.positions(df, ["g", "k"]).collect()
    assert [r.position for r in sorted(rows, key=lambda r: (r.g, r.k))] == list(range(1, 5001))
    assert windows.positions(df.limit(0), ["g", "k"]).count() == 0


def test_sampled_roots(spark):
    df = spark.createDataFrame([("a", s, i) for i, s in enumerate("xyxzwx")] + [("b", None, 9)], "g string, s string, i int")
    assert sorted((r.g, r.hits, r.distinct_samples, r.samples) for r in windows.sampled_roots(df, ["g"], "s", "i", 2).collect()) == [("a", 6, 4, "x,y"), ("b", 1, 1, "")]


def test_merged_seeds(spark):
    schema = "seq int, id string, company_name string, domain string, address string, industry string, confidence double, asn array<int>, cidr array<string>, tags array<string>, evidence array<struct<source:string,kind:string,value:string>>"
    rows = [
        (1, "seed-1", "Alpha Corp", "example.com", "", " ", 0.2, [64500], ["203.0.113.0/24"], ["East"], [("manual", "company_name", "Alpha Corp")]),
        (2, "seed-2", "Beta Corp", "Example.com ", "Street", "trade", 0.4, [64501, 64500], ["198.51.100.0/24"], ["west", ""], [("manual", "company_name", "Beta Corp"), ("", "", " ")]),
        (3, "seed-3", "ALPHA corp", "example.com", "Other", "x", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    r = fold.merge_seeds(df).first()
    assert (r.seed_key, r.id, r.company_name, r.address, r.industry, r.confidence, r.merged, r.conflicts) == ("example.com", "seed-1", "Alpha Corp", "Street", "trade", 0.4, 3, 1)
    assert (r.asn, r.cidr, r.tags) == ([64500, 64501], ["198.51.100.0/24", "203.0.113.0/24"], ["east", "west"])
    got = sorted((x.source, x.kind, x.value) for x in fold.seed_evidence(df).collect())
    assert got == [("manual", "company_name", "alpha corp"), ("manual", "company_name", "beta corp"), ("seed_merge", "company_name", "beta corp")]


def test_ids_take_no_provenance(spark):
    """Ids and ownership alone are those of the canonical assets, without the distinct provenance and the sets that only other columns need."""
    rng = random.Random(3)
    rows = [(rng.randrange(1000), f"o{i}", rng.choice(["e1", None]), rng.choice(["ip", "domain", None]), rng.choice([" A.org", "a.org", "10.0.0.1", None]), "crt.sh", rng.choice(["discovery", "enrichment"]), rng.choice(["", "", "owned", "uncertain"]), "", i) for i in range(200)]
    obs = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], SIGHTING).repartition(3)
    some = ["type", "asset_key", "asset_id", "ownership_state"]
    got = fold.asset_ids(obs)
    assert sorted(map(str, got.select(some).collect())) == sorted(map(str, fold.canonical_assets(obs).select(some).collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "Join" not in plan
