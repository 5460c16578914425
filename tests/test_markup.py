"""Captured pages, sitemaps and URLs: literal inputs and what they must give."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from latticework.functions import keys, names
from latticework.sources import captures, markup, pages, records
from latticework.sources.markup import sitemap_of


def _values(spark, column, cases):
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    return {r["raw"]: r["out"] for r in df.select("raw", column(F.col("raw")).alias("out")).collect()}


URLS = {
    "HTTPS://Example.COM:443/a/?utm_source=x&b=2&a=1#top": "https://example.com/a/?a=1&b=2",
    "http://example.com": "http://example.com/",
    "http://example.com:80?x": "http://example.com/?x=",
    "http://example.com:8080/": "http://example.com:8080/",
    "https://h.org/?a-b=1&a=2": "https://h.org/?a=2&a-b=1",
    "https://h.org/?a=2&a=1": "https://h.org/?a=2&a=1",
    "https://h.org/?q=a b+c%2Bd": "https://h.org/?q=a+b+c%2Bd",
    "https://h.org/?q=%7e*%c3%a9": "https://h.org/?q=~%2A%C3%A9",
    "https://h.org/?A=1&GCLID=2&mc_eid=3&=4&fbclid": "https://h.org/?a=1",
    "https://h.org/?x=%zz&y=1&s=1;2": "https://h.org/?y=1",
    "https://h.org/é b": "https://h.org/%C3%A9%20b",
    "https://h.org/a%2Fb(c)": "https://h.org/a%2Fb(c)",
    "https://h.org/%zz": None,
    "https://u:p@H.org./x": "https://u:p@h.org/x",
    "https://[2001:DB8::1]:8443/x": "https://[2001:db8::1]:8443/x",
    "ftp://h.org/": None, "/x": None, "": None, "https:///x": None, "mailto:a@b.c": None,
}


def test_normalized_urls(spark):
    assert _values(spark, keys.normalized_url, URLS) == URLS


def test_hosts_of_urls(spark):
    cases = {"https://A.example.com.:8080/x?y": "a.example.com", "a.example.com/x": "a.example.com", "https://[2001:DB8::1]:8443/": "2001:db8::1", "https://u:p@h.org/": "h.org"}
    assert _values(spark, keys.url_host, cases) == cases


def test_texts(spark):
    cases = {"  a \n\t b  ": "a b", "": "", "x": "x"}
    assert _values(spark, keys.squeezed, cases) == cases
    cases = {"abcdef": "abcde...", "abcd": "abcd", "abcdé": "abcd...", "ab   c": "ab...", "éé": "éé", "ééé": "éé..."}
    assert _values(spark, lambda c: keys.truncated(c, 5), cases) == {**cases, "ab   c": "ab..."}
    row = spark.createDataFrame([(None, " ", " b ")], "a string, b string, c string")
    assert row.select(keys.first_non_empty(F.col("a"), F.col("b"), F.col("c")).alias("x")).first().x == "b"


PAGE = """
<html><head><title>Legal Center</title></head><body>
  <a href="/privacy">Privacy Policy</a>
  <a href="https://example-holdings.com/about">About the Group</a>
  <a href="javascript:void(0)">Ignore me</a>
</body></html>"""


def test_links_are_resolved_and_classed(spark):
    df = spark.createDataFrame([(1, "https://example.com/legal/", PAGE)], "page_id int, url string, html string")
    got = [(r.pos, r.title, r.target_url, r.target_host, r.anchor_text, r.relation, r.nofollow) for r in pages.page_links(df).orderBy("pos").collect()]
    assert got == [(0, "Legal Center", "https://example.com/privacy", "example.com", "Privacy Policy", "privacy", False), (1, "Legal Center", "https://example-holdings.com/about", "example-holdings.com", "About the Group", "about", False)]


def test_links_of_bad_markup(spark):
    """Anchors without an end, nested ones, other quotes, entities, repeats, a cap that counts usable distinct links, pages without anything."""
    html = """<TITLE> </TITLE><title>A &amp; B</title><a href="/a">no close <a href='/b'>B</a> x <a href=rel/d>D</a><a href="//Other.org/x?b=1&amp;a=2" rel="NoFollow me"><b>O</b>
      <script>var t = "</p>";</script></a><a>none</a><a href="#x">f</a><a href="tel:1">t</a><a href="/B">B</a><a href="/b">b</a><a href="/b"> B </a><!-- <a href="/no">no</a> --><a href="/e"/>"""
    df = spark.createDataFrame([(1, "https://h.org/x/y?z", html), (2, "https://h.org/", None), (3, "https://h.org/", ""), (4, "no url", '<a href="/a">a</a>')], "page_id int, url string, html string")
    rows = pages.page_links(df).orderBy("page_id", "pos").collect()
    assert [(r.pos, r.target_url, r.anchor_text, r.nofollow) for r in rows] == [
        (0, "https://h.org/a", "no close", False), (1, "https://h.org/b", "B", False), (2, "https://h.org/x/rel/d", "D", False), (3, "https://other.org/x?a=2&b=1", 'O var t = "</p>";', True),
        (4, "https://h.org/B", "B", False), (5, "https://h.org/e", "", False),
    ]
    assert {r.title for r in rows} == {"A & B"}
    many = "".join(f'<a href="mailto:x@y.z">m</a><a href="/p{i // 2}">p</a>' for i in range(600))
    df = spark.createDataFrame([(1, "https://h.org/", many)], "page_id int, url string, html string")
    assert [r.target_url for r in pages.page_links(df).orderBy("pos").collect()] == [f"https://h.org/p{i}" for i in range(128)]


def test_fetchable_pages(spark):
    df = spark.createDataFrame([(1, 200, "text/html; charset=utf-8"), (2, 404, "text/html"), (3, 200, "image/png"), (4, 301, None), (5, 399, "application/XHTML+xml")], "id int, status int, content_type string")
    assert sorted(r.id for r in pages.fetchable(df).collect()) == [1, 4, 5]


def test_hints(spark):
    html = """<link rel="shortcut canonical" href=" https://o.com/ "><link rel='alternate' hreflang=fr href="/fr"><link rel="alternate" href="/feed">
      <meta property="OG:URL" content="https://o.com/x"><meta name=og:url content='y'><a href="/z"> Z <i>z</i> </a><a href="">e</a>"""
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert sorted((r.raw, r.text) for r in records.ownership_hint_links(df).collect()) == [("/fr", "alternate"), ("/z", "Z z"), ("https://o.com/", "canonical"), ("https://o.com/x", "canonical"), ("y", "canonical")]


@pytest.mark.parametrize(("body", "root", "locs", "error"), [
    ('<urlset xmlns="u"><url><loc> https://a.com/1 </loc></url><url><LOC>https://a.com/2</LOC><x:loc xmlns:x="i">https://a.com/3</x:loc></url></urlset>', "urlset", ["https://a.com/1", "https://a.com/2", "https://a.com/3"], None),
    ('<?xml version="1.0" encoding="ISO-8859-1"?><!-- c --><s:sitemapindex xmlns:s="u"><s:sitemap><s:loc>https://a.com/é.xml</s:loc></s:sitemap></s:sitemapindex>', "sitemapindex", ["https://a.com/é.xml"], None),
    ("<urlset><url><loc>a</loc></url>", "urlset", [], "no well-formed XML"), ("<urlset><loc>a & b</loc></urlset>", "urlset", [], "no well-formed XML"),
    ("<feed><loc>a</loc></feed>", "feed", [], 'unsupported sitemap root "feed"'), ("", "", [], "empty"), (None, "", [], "empty"), ("no xml", "", [], "no well-formed XML"),
    ("<urlset><loc></loc><loc><![CDATA[c]]><b>no</b>d</loc></urlset>", "urlset", ["cd"], None),
])
def test_sitemaps(body, root, locs, error):
    got = sitemap_of(body)
    assert got[:2] == (root, locs) and (got[2] is None if error is None else got[2].startswith(error))


def test_one_bad_sitemap_ends_no_job(spark):
    df = spark.createDataFrame([(1, "<urlset><loc>a</loc></urlset>"), (2, "<urlset><loc>a"), (3, None)], "seed_id int, body string")
    assert [(r.seed_id, r["loc"]) for r in captures.sitemap_locs(df).collect()] == [(1, "a")]
    assert sorted(r.seed_id for r in captures.sitemap_errors(df).collect()) == [2, 3]


def test_resolved_against_a_page(spark):
    cases = {"javascript:void(0)": None, "data:x": None, "?q=1": "https://h.org/a/b?q=1", "../c#f": "https://h.org/c"}
    assert _values(spark, lambda c: names.resolve_url(F.lit("https://h.org/a/b"), c), cases) == cases


def test_pages_that_break_parsers_end_no_job(spark):
    """Marked sections, declarations and rubbish: links outside of them are found, and no page raises."""
    import random

    from latticework.sources import pages as pages_source
    from latticework.sources.markup import page_elements, page_errors

    for html in ("<![foo[x]]><a href='/a'>t</a>", "<a href='/a'>t</a><![if !IE]>", "<![CDATA[x]]><a href='/a'>t</a>", "<!DOCTYPE html [<!ENTITY x 'y'>]><a href='/a'>t</a>", "<![foo[ <a href='/a'>t</a>"):
        rows, error = page_elements(html)
        assert error is None and ([r["href"] for r in rows if r["tag"] == "a"] or "<![foo[ " in html), html
    rng, parts = random.Random(3), ["<!", "<![", "[", "]]>", ">", "<a href='/x'>", "</a>", "<!--", "-->", "<?", "?>", "&#", "&#x110000;", "&;", "<title>", "<script>", "</script", "\x00", "'", '"', "=", " ", "é", "<!DOCTYPE", "<!ELEMENT", "CDATA[", "temp[", "<a", "/>"]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(4000)]
    for html in pages:
        page_elements(html)
    df = spark.createDataFrame([(i, "https://a.org/", p) for i, p in enumerate([*pages[:300], None, "", "<![foo[x]]><a href='/a'>t</a>"])], "page_id bigint, url string, html string")
    assert [r.target_url for r in pages_source.page_links(df.filter("page_id = 302")).collect()] == ["https://a.org/a"]
    assert page_errors(df, ["page_id"]).filter("error is null").count() == 0


def test_an_unreadable_page_gives_an_error_row(spark, monkeypatch):
    from latticework.sources import markup

    real = markup._Page.handle_starttag

    def broken(self, tag, attrs):
        real(self, tag, attrs)
        if dict(attrs).get("href") == "/bad":
            raise AssertionError("no such thing")

    monkeypatch.setattr(markup._Page, "handle_starttag", broken)
    rows, error = markup.page_elements("<a href='/a'>x</a><a href='/bad'>y</a><a href='/c'>z</a>")
    assert [r["href"] for r in rows] == ["/a", "/bad"] and error == "AssertionError: no such thing"


def test_few_bodies_at_once():
    """A worker parses a batch of very many or very long bodies in slices; none is lost, nulls and a body beyond the bound included."""
    bodies = ["x" * 10] * 1000 + [None, "y" * (2 * markup.BYTES), ""] + ["z" * (markup.BYTES // 3)] * 7
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(bodies))), pa.array(bodies)], names=["page_id", "html"])
    parts = list(markup.few(iter([batch, batch.slice(0, 0)]), 1))
    assert [x for p in parts for x in p.column(1).to_pylist()] == bodies
    assert all(p.num_rows == 1 or p.num_rows <= markup.ROWS and sum(len(x or "") for x in p.column(1).to_pylist()) <= markup.BYTES for p in parts)
