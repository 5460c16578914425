"""Addresses of both kinds, scopes, seeds and evidence: literal cases."""

from ipaddress import ip_address

from pyspark.sql import functions as F

from latticework.functions import keys
from latticework.operators import graph, scope


def test_addresses_as_numbers_and_bits(spark):
    good = ["203.0.113.10", "0.0.0.0", "255.255.255.255", "2001:db8::10", "::", "::1", "1::", "FE80::A:0:B", "1:2:3:4:5:6:7:8", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "::ffff:203.0.113.10", "64:ff9b::192.0.2.33"]
    bad = ["", "1.2.3", "256.0.0.1", "01.2.3.4", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", "12345::", "g::", "1:2:3:4:5:6:7::8", "::1.2.3", "h.org", ":1:2:3:4:5:6:7"]
    df = spark.createDataFrame([(x,) for x in good + bad] + [(None,)], "ip string")
    for r in df.select("ip", keys.ip_bits(F.col("ip")).alias("bits"), keys.ip6_numbers(F.col("ip")).alias("n")).collect():
        if r.ip in good:
            a = ip_address(r.ip)
            assert r.bits == format(int(a), f"0{a.max_prefixlen}b"), r.ip
            assert (r.n is None) if a.version == 4 else ((r.n.hi % 2**64, r.n.lo % 2**64) == divmod(int(a), 2**64)), r.ip
        else:
            assert r.bits is None and r.n is None, r.ip


def test_addresses_in_prefixes(spark):
    ips = spark.createDataFrame([("203.0.113.10",), ("203.0.114.1",), ("2001:DB8::10",), ("2001:db9::1",), ("no",), (None,)], "ip string")
    prefixes = spark.createDataFrame([("203.0.113.0/24",), ("0.0.0.0/0",), ("203.0.113.10/32",), ("2001:db8::/32",), ("2001:db8::10/128",), ("203.0.113.0/33",), ("203.0.113.0",), ("x/8",), ("::/0",)], "cidr string")
    got = sorted((r.ip, r.cidr) for r in graph.addresses_in_prefixes(ips, prefixes).collect())
    assert got == [
        ("2001:DB8::10", "2001:db8::/32"), ("2001:DB8::10", "2001:db8::10/128"), ("2001:DB8::10", "::/0"), ("2001:db9::1", "::/0"),
        ("203.0.113.10", "0.0.0.0/0"), ("203.0.113.10", "203.0.113.0/24"), ("203.0.113.10", "203.0.113.10/32"), ("203.0.114.1", "0.0.0.0/0"),
    ]


def test_followup_hosts_stay_in_scope(spark):
    parents = spark.createDataFrame([("seed-1", "Alpha", "Street", "trade", ["East", "ptr-recursion"])], "id string, company_name string, address string, industry string, tags array<string>")
    pointers = spark.createDataFrame([("seed-1", "WWW.Example.com.", "example.com"), ("seed-1", "www.example.com", "example.com"), ("seed-1", "vps.example.net.", "example.net"), ("seed-2", "a.example.com", "example.com")], "seed_id string, host string, root string")
    roots = spark.createDataFrame([("seed-1", "example.com")], "seed_id string, root string")
    got = [tuple(r) for r in scope.followup_hosts(parents, pointers, roots).collect()]
    assert got == [("seed-1:ptr:www.example.com", "www.example.com", ["www.example.com"], "Street", "trade", ["east", "ptr-recursion"])]


def test_discovered_seeds(spark):
    parents = spark.createDataFrame([("p", " ", None, "trade", None)], "id string, company_name string, address string, industry string, tags array<string>")
    found = spark.createDataFrame([("p", "a.com"), ("p", "a.com"), ("p", ""), ("q", "b.com")], "parent_id string, root string")
    assert [tuple(r) for r in scope.discovered_seeds(parents, found, "Crawl").collect()] == [("p:a.com", "p", ["a.com"], None, "trade", ["crawl"])]


def test_roots_outside_the_scope(spark):
    known = spark.createDataFrame([("s", "in.com")], "seed_id string, root string")
    urls = spark.createDataFrame([("s", "d1", "u1", "a.com", 1), ("s", "d2", "u1", "a.com", 5), ("s", "d2", "u2", "in.com", 2), ("s", "d2", "u3", "a.com", 3), ("s", "d1", "u4", "b.com", 4), ("s", "d1", "u5", "c.com", 6)], "seed_id string, doc string, url string, root string, pos int")
    got = {r.root: (r.documents, r.samples) for r in scope.sitemap_roots(urls, known, most_urls=4, most_roots=1, samples=1).collect()}
    assert got == {"a.com": (["d1", "d2"], ["u1"])}
    hints = spark.createDataFrame([("s", "a.com", "/X", "T", 1), ("s", "a.com", "/x ", "t", 2), ("s", "a.com", "/y", "t", 3), ("s", "in.com", "/", "", 4), ("s", None, "/", "", 5)], "seed_id string, root string, href string, text string, pos int")
    got = [(r.root, r.hints, [tuple(x) for x in r.samples]) for r in scope.hint_roots(hints, known, 1).collect()]
    assert got == [("a.com", 2, [("/X", "T")])]
    found = spark.createDataFrame([("s", "t1", "a.com", 1), ("s", "t2", "b.com", 2), ("s", "t2", "a.com", 3), ("s", "t1", "in.com", 4), ("s", "t3", "c.com", 5)], "seed_id string, term string, root string, pos int")
    assert sorted((r.root, r.terms) for r in scope.terms_per_root(found, known, 2).collect()) == [("a.com", ["t1", "t2"]), ("b.com", ["t2"])]


def test_evidence_lines(spark):
    roots = spark.createDataFrame([("s", "a.com", 2, 2, ["investor_relations", "about", "anchor"], ["x", "y"]), ("s", "b.com", 1, 1, ["anchor"], [])], "seed_id string, root string, links bigint, referrers bigint, relations array<string>, samples array<string>")
    got = sorted((r.root, r.position, r.kind, r.summary) for r in scope.crawl_evidence(roots).collect())
    assert got == [
        ("a.com", 0, "crawl_link_summary", "Observed 2 outbound link(s) from 2 crawled page(s)"), ("a.com", 1, "crawl_first_party_context", "Linked from first-party page contexts tagged as: about, investor_relations"),
        ("a.com", 2, "crawl_link_samples", "Sample crawl edges: x ; y"), ("b.com", 0, "crawl_link_summary", "Observed 1 outbound link(s) from 1 crawled page(s)"),
    ]


def test_baseline(spark):
    roots = spark.createDataFrame([("s", "a.com")], "seed_id string, root string")
    records = spark.createDataFrame([("s", "a", "10.0.0.1", None), ("s", "AAAA", "2001:DB8::1", None), ("s", "MX", "mail.b.com", "b.com"), ("s", "SOA", "x", "y.com")], "seed_id string, type string, value string, root string")
    registered = spark.createDataFrame([("s", "Alpha, Inc.", "ops@x.c.com", "c.com", ["d.net", None]), ("s", "", "no mail", "e.com", None)], "seed_id string, registrant_org string, registrant_email string, email_root string, name_server_roots array<string>")
    r = scope.seed_baseline(roots, records, registered).first()
    assert (r.roots, r.ips, r.mail_roots, r.ns_roots, r.orgs, r.email_roots, r.txt_roots) == (["a.com"], ["10.0.0.1", "2001:db8::1"], ["b.com"], ["d.net"], ["alpha inc"], ["c.com"], [])


def test_promoted_observations(spark):
    decisions = spark.createDataFrame([("e", "a.com", "accepted"), ("e", "b.com", "rejected"), ("e", "c.com", "pending")], "enumeration_id string, root string, decision string")
    facts = spark.createDataFrame([("a.com", "Org")], "root string, registrant string")
    assert [tuple(r[c] for c in ("type", "identifier", "source", "enumeration_id", "registrant")) for r in scope.promoted_observations(decisions, facts, "dns_collector").collect()] == [("domain", "a.com", "dns_collector", "e", "Org")]


def test_parts_of_roots(spark):
    df = spark.createDataFrame([("example.co.uk",), ("localhost",), ("203.0.113.1",), ("2001:db8::1",)], "root string")
    got = {r.root: (r.a, r.b) for r in df.select("root", keys.root_label(F.col("root")).alias("a"), keys.root_suffix(F.col("root")).alias("b")).collect()}
    assert got == {"example.co.uk": ("example", "co.uk"), "localhost": ("localhost", ""), "203.0.113.1": ("203.0.113.1", ""), "2001:db8::1": ("2001:db8::1", "")}


def test_graph_with_danglings(spark):
    obs = spark.createDataFrame([("o1", "A"), ("o2", "gone"), ("o3", ""), ("o4", None)], "id string, asset_id string")
    assets = spark.createDataFrame([("A",)], "asset_id string")
    assert sorted(map(tuple, graph.stray_observations(obs, assets).collect())) == [("o2", "unknown"), ("o3", "without"), ("o4", "without")]


def test_late_sightings_lower_the_first_date(spark, tmp_path):
    """Sightings out of order, over several batches of the stream."""
    from latticework.streaming.live_assets import live_assets

    schema = "type string, identifier string, seen_us bigint"
    for n, seen in enumerate((50, 20, 70)):
        spark.createDataFrame([("domain", "A.com", seen), ("domain", "a.com ", seen + 1)], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        got = live_assets(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "in/*")), str(tmp_path / "live"), str(tmp_path / "progress")).collect()
    assert [tuple(r) for r in got] == [("domain", "a.com", 6, 20, 71)]


def test_normal_forms(spark):
    obs = spark.createDataFrame([(" o1 ", " A.com", " CRT.sh ", "Enrichment ", " OWNED", " why ")], "id string, identifier string, source string, kind string, ownership_state string, inclusion_reason string")
    assert tuple(scope.normalized(obs).first()) == ("o1", "a.com", "crt.sh", "enrichment", "owned", "why")
    assert scope.normalized(obs.withColumn("kind", F.lit("else"))).first().kind == "discovery"
    edge = spark.createDataFrame([(" r ", " A.com ", " DNS_A ")], "id string, from_identifier string, kind string")
    assert tuple(scope.normalized(edge).first()) == ("r", "a.com", "dns_a")


def test_small_filters(spark):
    df = spark.createDataFrame([("a", ["x"]), ("b", ["z", "x", "y"])], "root string, evidence array<string>")
    rows = scope.beyond_first_hit(df).select("root", scope.sorted_limit(F.col("evidence"), 2).alias("e")).collect()
    assert [tuple(r) for r in rows] == [("b", ["x", "y"])]


def test_trees_scan_each_table_once_and_shuffle_little(spark):
    """Nodes and lines are projections of four stored tables: one exchange for the groups, a join for the lines; no source is read again."""
    from latticework.operators import trees
    from latticework.plans.expanded import _tree_tables

    tables = _tree_tables(spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(trees.nodes(tables)).count("Exchange ") <= 2 and plan(trees.details(tables)).count("Exchange ") <= 6
    assert "events.parquet" not in plan(trees.nodes(tables)) + plan(trees.details(tables))
