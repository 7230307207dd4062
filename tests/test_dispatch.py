"""Dispatch by segments beside patterns tried one by one, and bounded page numbers."""

from __future__ import annotations

import re

from seriatim.operators import routing
from seriatim.sources import crawl

PATTERNS = [
    "^/[a-z]+/[0-9]+/$", "^/[a-z]+/[0-9]+[.]html$", "^/[a-z]+/[0-9]+([.]html)?/?$", "^/[A-Za-z]+[,.]?$", "^/w/[0-9]+", "^/[^/]+$", "^/[^/]+/?$", "^/w/[^/]+/v-[0-9]+[.]x/?$",
    "^/$", "^/?$", "^/w/1/$", "^/w\\.x/\\w+$", "/w/", "^/w/.*$", "^/(w|v)/[0-9]+$", "^/w//[0-9]+$", "^/w/[^/]+-[^/]+$", "^/w/a[0-9]+b$", "^/w/$",
]
PATHS = ["", "/", "//", "/w", "/w/", "/w/1", "/w/1/", "/w/1.html", "/w/12/v-3.x", "/w/12/v-3.x/", "/w/12/v-.x", "/w.x/ab", "/wax/ab", "/W,", "/v/7", "/w//5", "/w/a-b", "/w/a12b", "/w/ab", "/w/1/2", "/é/9", "/w/1//"]


def test_same_forms_as_tried_one_by_one(spark):
    rows = [(n, 1, f"r{n}", "h", ["https"], "k", p, "", "", None) for n, p in enumerate(PATTERNS)]
    rules = spark.createDataFrame(rows, routing.RULE_SCHEMA)
    urls = spark.createDataFrame([(f"https://h{p}",) for p in PATHS] + [("https://other/w/1",), (None,)], "url string")
    got = {(r["url"], r["priority"]) for r in routing.matching_forms(urls, rules).collect()}
    want = {(f"https://h{p}", n) for p in PATHS for n, x in enumerate(PATTERNS) if re.search(x.replace("\\w", "[A-Za-z0-9_]"), p)}
    assert got == want
    first = {r["url"]: r["rule"] for r in routing.route(urls, rules).collect()}
    assert first == {u: f"r{min(n for x, n in want if x == u)}" if any(x == u for x, _ in want) else None for u in first}
    # only patterns that are no plain segments are left to be tried
    other = {r["path_regex"] for r in routing.segmented(rules).where("_segs IS NULL").collect()}
    assert other == {"^/[a-z]+/[0-9]+([.]html)?/?$", "^/[A-Za-z]+[,.]?$", "^/w/[0-9]+", "^/?$", "/w/", "^/w/.*$", "^/(w|v)/[0-9]+$", "^/w/[^/]+-[^/]+$"}


def test_many_forms_of_one_host(spark):
    n = 100_000
    rules = spark.range(n).selectExpr(
        "CAST(id AS int) AS priority", "1 AS form", "concat('r', id) AS rule", "'h' AS host", "array('https') AS schemes", "'k' AS kind",
        "concat('^/title-', id, '/[0-9]+$') AS path_regex", "'' AS query_key", "'' AS publisher", "CAST(NULL AS string) AS host_publisher",
    )
    urls = spark.createDataFrame([(f"https://h/title-{k}/{k}",) for k in (0, 7, 99_999, 100_000)] + [("https://h/title-7/x",)], "url string")
    got = {r["url"]: r["rule"] for r in routing.route(urls, rules).collect()}
    assert got == {"https://h/title-0/0": "r0", "https://h/title-7/7": "r7", "https://h/title-99999/99999": "r99999", "https://h/title-100000/100000": None, "https://h/title-7/x": None}


def test_large_counts_come_in_stretches(spark):
    counts = spark.createDataFrame([(1, 3), (2, 0), (3, None), (4, 100), (5, 64), (6, 5)], "k long, n long").selectExpr("*", "concat('p', k, '/') AS base")
    for stretch in (4, 1 << 16):
        pages = crawl.pages_by_count(counts, "base", "n", stretch)
        got = sorted((r["k"], r["page_no"], r["page_url"]) for r in pages.collect())
        assert got == [(k, n, f"p{k}/{n}.jpg") for k, last in ((1, 3), (4, 100), (5, 64), (6, 5)) for n in range(1, last + 1)]
