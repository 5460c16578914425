"""Queries against their SQL on rows that the smallest tables lack, and plans that must not grow."""

import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_queries import SF, TABLES

from latticework.operators import crawl, graph
from latticework.plans.queries import ORACLE_SQL, QUERIES
from latticework.sources import records


def _differences(spark, at, name, **tables):
    """Rows of the query and of its SQL that the other lacks, on the smallest tables with some of them replaced."""
    db = duckdb.connect()
    for t in TABLES:
        rows = tables.get(t, pq.read_table(f"{SF}/{t}.parquet"))
        pq.write_table(rows, f"{at}/{t}.parquet")
        db.execute(f"create view {t} as select * from '{at}/{t}.parquet'")
    df = QUERIES[name](spark, str(at))
    got = [tuple(r) for r in df.collect()]
    want = db.execute(f"select {', '.join(df.columns)} from ({ORACLE_SQL[name]})").fetchall()
    return [r for r in got if r not in want], [r for r in want if r not in got], len(got) - len(want)


def test_ownership_beyond_one_net(spark, tmp_path):
    """Addresses in several /24s: a seed's prefix counts in each."""
    events = pq.read_table(f"{SF}/events.parquet")
    users = pa.array([(i * 7) % 1500 for i in range(len(events))], events.schema.field("user_id").type)
    events = events.set_column(events.schema.get_field_index("user_id"), events.schema.field("user_id"), users)
    assert _differences(spark, tmp_path, "ip_ownership", events=events) == ([], [], 0)


@pytest.mark.parametrize("name", ["page_links", "ownership_hint_links"])
def test_cut_references_stay_as_they_are(spark, tmp_path, name):
    page = lambda title, text: f'<html><head><title>{title}</title></head><body><a href="/a">{text}</a></body></html>'
    told = [("a &amp; b &amp", "x &am"), ("c &quot;d &#39;", "y &lt; z &gt"), ("e && f &", "&amp;lt; w")]
    pages = pa.table({"page_id": pa.array(range(3), pq.read_schema(f"{SF}/pages.parquet").field("page_id").type), "url": [f"https://h.org/{i}" for i in range(3)], "html": [page(*x) for x in told]})
    assert _differences(spark, tmp_path, name, pages=pages) == ([], [], 0)


def _below(df, node, word):
    """Lines of the optimized plan with ``word`` below a ``node``."""
    out, depths = [], []
    for line in re.split(r"\n(?=[ :]*[:+]- )", df._jdf.queryExecution().optimizedPlan().toString()):  # expressions hold line feeds
        text = line.lstrip(" :+-")
        depth = len(line) - len(text)
        depths = [d for d in depths if d < depth]
        if depths and word in text:
            out.append(text)
        if text.startswith(node):
            depths.append(depth)
    return out


def test_each_address_is_read_once(spark):
    """Bits are read of distinct spellings, not of every row; repeats, broken ones and nulls."""
    ips = spark.createDataFrame([(x,) for x in ["10.0.0.1", "10.0.0.1", "::1", "x", None, "10.1.0.1"] * 3], "ip string")
    cidrs = spark.createDataFrame([(x,) for x in ["10.0.0.0/16", "10.0.0.0/16", "::/64", "10.0.0.0/99", "y/8", None, "10.0.0.0"]], "cidr string")
    got = graph.addresses_in_prefixes(ips, cidrs)
    assert sorted(map(tuple, got.collect())) == [("10.0.0.1", "10.0.0.0/16"), ("::1", "::/64")]
    assert not _below(got, "Aggregate [ip", "conv(") and not _below(got, "Aggregate [cidr", "conv(")


def test_each_sitemap_line_is_read_once(spark):
    bodies = spark.createDataFrame([("https://o.com/a/robots.txt", "User-agent: *\r\n sitemap: /x/../M.xml#t\nSitemap: b.xml\nSITEMAP: HTTPS://O.com/a/b.xml\nsitemap:\nSitemap: mailto:x"), ("https://p.com/", None)], "base string, body string")
    got = records.robots_sitemaps(bodies)
    assert sorted(map(tuple, got.collect())) == [("https://o.com/a/robots.txt", "https://o.com/M.xml"), ("https://o.com/a/robots.txt", "https://o.com/a/b.xml")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("(?i)^https?://[^/]") == 1


def test_answers_are_parsed_before_roots_are_joined(spark):
    """Each answer is parsed once, not again for the roots of its candidates."""
    rules = spark.createDataFrame([("com", False, False)], "suffix string, is_wildcard boolean, is_exception boolean")
    item = '{"title":"%s","url":"%s","snippet":"s"}'
    told = ",".join(item % x for x in [(" B ", " https://b.org/"), ("A", "https://b.org/"), ("C", "https://a.org/"), ("D", "ftp://d"), ("", "https://e.org/")])
    body = '```{"queries":[" Who ","who","","What"],"candidates":[{"root":" www.A.com","summary":" s ","evidence":[%s]},{"root":"a.com","summary":"t","evidence":[%s]},{"root":"b.com","summary":"","evidence":[]}]}```' % (told, told)
    bodies = spark.createDataFrame([(1, body), (2, "no answer"), (3, None)], "seed_id bigint, body string")
    got = records.search_candidates(bodies, rules)
    assert [(r.seed_id, r["rank"], r.root, r.summary, [(e.url, e.title) for e in r.evidence]) for r in got.collect()] == [(1, 1, "a.com", "s", [("https://a.org/", "C"), ("https://b.org/", "B")])]
    assert sorted((r.pos, r.query) for r in records.search_queries(bodies).collect()) == [(0, "Who"), (1, "What")]
    decided = records.decisions_from_text(spark.createDataFrame([(1, 'x {"decisions":[{"root":"A.com","collect":true,"confidence":3},{"root":"w.a.com","confidence":0.5},{"root":""}]}'), (2, None)], "seed_id bigint, body string"), rules)
    assert [tuple(r) for r in decided.select("seed_id", "root", "collect", "confidence").collect()] == [(1, "a.com", False, 0.5)]
    for df in (got, decided):
        assert "from_json" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_crawled_links_get_their_hosts_once(spark):
    """What tells the links is read before the crawl's results, which are three ways to use them."""
    site = spark.createDataFrame([("https://a.com/", "https://a.com/"), ("https://w.a.com/1", "https://w.a.com/1")], "url string, final_url string")
    hosts = spark.createDataFrame([("https://a.com/", "a.com", "a.com"), ("https://w.a.com/1", "w.a.com", "a.com"), ("https://b.net/", "b.net", "b.net")], "url string, host string, root string")
    links = spark.createDataFrame([("https://a.com/", "https://w.a.com/1", 1, "x"), ("https://w.a.com/1", "https://b.net/", 2, "yz")], "url string, target string, pos bigint, relation string").withColumn("relation", F.reverse("relation"))
    scope = spark.createDataFrame([(1, "a.com")], "seed_id bigint, root string")
    got = crawl.crawl(spark.createDataFrame([(1, "https://a.com/", 0)], "seed_id bigint, url string, pos bigint"), scope, site, hosts, links)
    assert sorted(map(tuple, got["pages"].collect())) == [(1, "https://a.com/", "https://a.com/", 0, 1), (1, "https://w.a.com/1", "https://w.a.com/1", 1, 2)]
    assert [tuple(r) for r in got["candidates"].collect()] == [(1, "b.net", "https://w.a.com/1", "https://b.net/", "zy")] and [tuple(r) for r in got["hosts"].collect()] == [(1, "w.a.com")]
    assert all("reverse(" not in df._jdf.queryExecution().optimizedPlan().toString() for df in got.values())


def test_tables_are_dealt_by_their_size(spark):
    """More rows than the session's partitions hold at the given number a task: more tasks; else the table stays as it is."""
    from latticework.session import spread

    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.range(20 * own).withColumn("k", F.col("id") % (2 * own))
    assert spread(df, "k", rows=10).rdd.getNumPartitions() == 2 * own
    assert spread(df, "k").rdd.getNumPartitions() == df.rdd.getNumPartitions()
    assert spread(df, "k", rows=10).groupBy("k").count().filter("count <> 10").isEmpty()


def test_outcomes_are_folded_to_numbers_before_texts_are_chosen(spark):
    """Outcomes that tell the same become one row before texts (which make Spark sort all rows) are chosen: the plan's first aggregates are hash aggregates."""
    from latticework.operators import judged

    rows = [("c", "s", "x", "r", i % 2 == 0, i / 10, i % 3 == 0, ["", "a", "b"][i % 3], i, ["", "one", "One"][i % 3], [" A", "a"]) for i in range(9)]
    df = spark.createDataFrame(rows, "collector string, seed_id string, scenario string, root string, collect boolean, confidence double, explicit boolean, kind string, eval_seq bigint, reason string, support array<string>").repartition(3)
    out = judged.judged_candidates(df, judged.GROUP)
    assert [tuple(r[c] for c in ("collect", "confidence", "explicit", "kind", "reason", "support")) for r in out.collect()] == [(True, 0.8, True, "b", "One", "A")]
    plan = judged._merged(df, judged.GROUP, ["kind", "reason"])._jdf.queryExecution().sparkPlan().toString()
    assert re.findall(r"(?<!\w)(Hash|Sort|ObjectHash)Aggregate\(", plan)[-1] == "Hash"  # the last in the text reads the rows
