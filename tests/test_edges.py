"""Odd rows: nulls, unreadable bodies, empty tables, oversize items, broken snapshots."""

import json

from pyspark.sql import functions as F

from latticework.functions import names
from latticework.operators import batches, enrich, frontier
from latticework.sources import records, registrations, snapshots


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_seeds(spark, tmp_path):
    path = tmp_path / "seeds.json"
    path.write_text(json.dumps([{"id": "a", "company_name": "A", "extra": 1}, {"company_name": " "}, {"domains": ["b.com"]}]))
    got = records.load_seeds(spark, str(path)).collect()
    assert [r["id"] for r in got][0] == "a" and len(got) == 2 and all(r["id"] for r in got)


def test_unreadable_bodies(spark):
    bodies = spark.createDataFrame([("s", None), ("s", ""), ("s", "no json"), ("s", "{}"), ("s", "[]")], "seed_id string, body string")
    rules = spark.createDataFrame([("com", False, False)], "suffix string, is_wildcard boolean, is_exception boolean")
    for f in (records.ct_term_names, records.passive_dns_hosts, records.announced_prefixes, records.search_queries, records.securitytxt_links):
        assert f(bodies).count() == 0
    assert records.search_candidates(bodies, rules).count() == 0 and records.decisions_from_text(bodies, rules).count() == 0
    assert registrations.from_whois(bodies.withColumnRenamed("seed_id", "domain")).count() == 0


def test_resolved_links(spark):
    cases = {"a/../../b": "http://h.com/b", "": None, "#x": None, "tel:1": None, "//o.com": "http://o.com", "/c/./d/..": "http://h.com/c/", "?q": "http://h.com/x/y?q", "HTTP://Z.com/#f": "HTTP://Z.com/"}
    df = spark.createDataFrame([(k,) for k in cases], "raw string").withColumn("url", names.resolve_url(F.lit("http://h.com/x/y?z"), F.col("raw")))
    assert {r["raw"]: r["url"] for r in df.collect()} == cases


def test_budget(spark):
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate([4, 4, 3, 99, 1, 10])] + [("b", 0, 11)], "g string, i int, n int")
    got = rows(batches.budget_batches(df, ["g"], "i", "n", 10), "g", "i", "batch")
    assert got == [("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("a", 3, None), ("a", 4, 2), ("a", 5, 3), ("b", 0, None)]


def test_waves_without_seeds(spark):
    seeds = spark.createDataFrame([], "seed_key string")
    told = spark.createDataFrame([("p", "c", "s", "k", 1.0, False)], "parent_key string, seed_key string, source string, kind string, confidence double, reasoned boolean")
    assert frontier.expand_frontier(seeds, told).count() == 0
    start = spark.createDataFrame([], "seed_id string, url string, pos int")
    links = spark.createDataFrame([], "seed_id string, url string, target string, pos int")
    assert frontier.reach(start, start.select("url"), links, 5).count() == 0


def test_cycles_end(spark):
    seeds = spark.createDataFrame([("p",)], "seed_key string")
    told = spark.createDataFrame([("p", "c", "s", "k", 1.0, False), ("c", "p", "s", "k", 1.0, False), ("c", "weak", "s", "k", 0.1, False)], "parent_key string, seed_key string, source string, kind string, confidence double, reasoned boolean")
    assert rows(frontier.expand_frontier(seeds, told), "seed_key", "wave") == [("c", 1), ("p", 0), ("weak", 4)]


def test_broken_snapshot(spark, tmp_path):
    one, path = spark.range(3), str(tmp_path / "s")
    snapshots.save_snapshot(spark, path, 1, {"t": one})
    spark.range(9).write.parquet(f"{path}/v=2/t")  # a version that broke off before its pointer
    assert snapshots.load_snapshot(spark, path)["t"].count() == 3


def test_search_reasons_are_cut_by_bytes(spark):
    make = spark.createDataFrame
    long = "é" * 200  # 400 bytes
    got = enrich.search_edges(make([("s", "r.com", long), ("s", "q.com", "short")], "seed_id string, root string, summary string"), make([("s", 1, "who"), ("s", 2, "what")], "seed_id string, pos int, query string"),
                              make([("s", "f.com")], "seed_id string, focus string"), make([("s", "r.com", True), ("s", "q.com", True)], "seed_id string, root string, collect boolean"))
    reasons = {r.to_identifier: r.reason for r in got.collect()}
    assert reasons == {"r.com": "who: " + "é" * 157 + "...", "q.com": "who: short"}
