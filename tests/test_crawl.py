"""Redirect chains and the crawl over them: literal cases, and random sites against a plain search."""

import random

from latticework.operators.crawl import contract_redirects, crawl, fetched_pages

ANSWER, LINK, HOST = "url string, target string, page boolean", "url string, target string, pos int, relation string", "url string, host string, root string"


def test_chains_loops_and_long_chains(spark):
    rows = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("z", "x"), ("in", "y"), ("self", "self"), ("two", "q"), ("two", "p")]
    rows += [(f"l{i}", f"l{i + 1}") for i in range(14)]  # ends at l14
    got = {r.url: (r.final_url, r.hops, r.error) for r in contract_redirects(spark.createDataFrame(rows, "url string, target string")).collect()}
    stop = (None, None, "stopped after 10 redirects")
    assert got["a"] == ("c", 2, None) and got["b"] == ("c", 1, None) and got["two"] == ("p", 1, None)
    assert [got[u] for u in ("x", "y", "z", "in", "self")] == [stop] * 5
    assert [got[f"l{i}"] for i in range(14)] == [stop if i < 4 else ("l14", 14 - i, None) for i in range(14)]


def test_redirects_out_of_scope_and_hosts(spark):
    """A page that redirects out of the scope is a candidate and its links don't count; one that redirects inside brings its host and links."""
    answers = [("s/", "s/home", None), ("s/home", None, True), ("s/away", "other/", None), ("other/", None, True), ("s/loop", "s/loop", None), ("s/404", None, False), ("s/old", "s/new", None), ("s/new", None, True)]
    links = [("s/home", "s/away", 1, "anchor"), ("s/home", "s/loop", 2, "anchor"), ("s/home", "s/404", 3, "anchor"), ("s/home", "s/old", 4, "legal"), ("s/home", "third/", 5, "about"), ("other/", "fourth/", 1, "anchor"), ("s/new", "blog/", 1, "contact"), ("s/new", "s/style.css", 2, "anchor")]
    hosts = [("s/home", "www.s.com", "s.com"), ("s/new", "s.com", "s.com"), ("other/", "www.other.net", "other.net"), ("third/", "third.org", "third.org"), ("fourth/", "fourth.org", "fourth.org"), ("blog/", "blog.s.com", "s.com")]
    hosts += [(u, "s.com", "s.com") for u in ("s/away", "s/loop", "s/404", "s/old", "s/style.css")]
    make = spark.createDataFrame
    got = crawl(make([("1", "s/", 0)], "seed_id string, url string, pos int"), make([("1", "s.com")], "seed_id string, root string"), fetched_pages(make(answers, ANSWER)), make(hosts, HOST), make(links, LINK))
    assert sorted(map(tuple, got["pages"].collect())) == [("1", "s/", "s/home", 0, 1), ("1", "s/away", "other/", 1, 2), ("1", "s/old", "s/new", 1, 3)]
    assert sorted(r.host for r in got["hosts"].collect()) == ["blog.s.com", "www.s.com"]
    assert sorted(tuple(r)[1:] for r in got["candidates"].collect()) == [("other.net", "s/away", "other/", "redirect"), ("third.org", "s/home", "third/", "about")]


def plain(start, scope, answers, links, hosts, most, depth):
    target = {u: t for u, t, _ in answers if t}
    readable = {u for u, t, p in answers if not t and p}
    by_page, where = {}, {u: (h, r) for u, h, r in hosts}
    for u, t, pos, rel in sorted(links, key=lambda x: x[2]):
        by_page.setdefault(u, []).append((t, rel))
    pages, found, out = [], set(), set()
    for seed, roots in scope.items():
        queue = [(u, 0) for _, u, _ in sorted((p, u, s) for s, u, p in start if s == seed)]
        queued, n = {u for u, _ in queue}, 0
        while queue and n < most:
            u, d = queue.pop(0)
            end, hops = u, 0
            while end in target and hops <= 10:
                end, hops = target[end], hops + 1
            if hops > 10 or end not in readable:
                continue
            n += 1
            pages.append((seed, u, end, d, n))
            host, root = where[end]
            if root not in roots:
                out.add((seed, root, u, end, "redirect"))
                continue
            if host != root:
                found.add((seed, host))
            for t, rel in by_page.get(end, []):
                h, r = where[t]
                if r not in roots:
                    out.add((seed, r, end, t, rel))
                    continue
                if h != r:
                    found.add((seed, h))
                if d < depth and t not in queued:
                    queued.add(t)
                    queue.append((t, d + 1))
    return set(pages), found, out


def test_random_sites(spark):
    rng = random.Random(8)
    urls = [f"u{i}" for i in range(60)]
    hosts = [(u, rng.choice(["", "www.", "a."]) + r, r) for u in urls for r in [rng.choice(["p.com", "q.com", "r.com", "z.net"])]]
    answers = [(u, *rng.choice([(rng.choice(urls), None), (None, True), (None, True), (None, False)])) for u in urls]
    links = [(rng.choice(urls), rng.choice(urls), i, rng.choice(["anchor", "legal"])) for i in range(150)]
    scope = {"1": {"p.com"}, "2": {"q.com", "r.com"}, "3": {"p.com", "z.net"}}
    start = [(s, u, i) for s in scope for i, u in enumerate(rng.sample(urls, 4))]
    make = spark.createDataFrame
    got = crawl(make(start, "seed_id string, url string, pos int"), make([(s, r) for s, rs in scope.items() for r in rs], "seed_id string, root string"), fetched_pages(make(answers, ANSWER)), make(hosts, HOST), make(links, LINK), most=6)
    pages, found, out = plain(start, scope, answers, links, hosts, 6, 2)
    assert {tuple(r) for r in got["pages"].collect()} == pages and len(pages) > 8
    assert {tuple(r) for r in got["hosts"].collect()} == found and found
    assert {tuple(r) for r in got["candidates"].collect()} == out and {r for *_, r in out} >= {"redirect", "anchor"}
