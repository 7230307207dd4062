"""Whole visits over a small catalogue."""

from __future__ import annotations

import pytest

from seriatim import visits
from seriatim.operators import routing

H = "https://a.example.com"


@pytest.fixture(scope="module")
def site(spark):
    rules = spark.createDataFrame(
        [
            (1, 1, "a", "a.example.com", ["https"], "series", "^/s/[0-9]+$", "", "", None),
            (1, 2, "a", "a.example.com", ["https"], "episode", "^/e/[0-9]+$", "", "", None),
        ],
        routing.RULE_SCHEMA,
    )
    listings = spark.createDataFrame(
        [(f"{H}/s/1", pos, f"{H}/e/{n}") for pos, n in enumerate((1, 2, 2, 3, 9))],
        "series_url string, pos int, episode_url string",
    )
    edges = spark.createDataFrame(
        [
            (f"{H}/e/{n}", f"{H}/e/{n - 1}" if n > 1 else None, f"{H}/e/{n + 1}" if n < 4 else None)
            for n in range(1, 5)
        ],
        "url string, prev_url string, next_url string",
    )
    episodes = spark.createDataFrame(
        [(f"{H}/e/{n}", "S", f"t{n}", "locked" if n == 2 else "saved") for n in range(1, 5)],
        "url string, series_title string, episode_title string, status string",
    )
    return rules, listings, edges, episodes


def seen(spark, site, url, **kind):
    urls = spark.createDataFrame([(url,), ("https://nowhere/",)], "url string")
    rows = visits.visit(urls, *site, **kind).orderBy("place").collect()
    return [int(r["url"].rsplit("/", 1)[1]) for r in rows]


def test_series_lists_its_episodes_once_and_walks_no_chain(spark, site):
    assert seen(spark, site, f"{H}/s/1", bulk=True) == [1, 2, 3]


def test_episode_alone_on_back_and_both(spark, site):
    assert seen(spark, site, f"{H}/e/2") == [2]
    assert seen(spark, site, f"{H}/e/2", bulk=True) == [2, 3, 4]
    assert seen(spark, site, f"{H}/e/2", back=True) == [1, 2]
    assert seen(spark, site, f"{H}/e/3", bulk=True, back=True) == [1, 2, 3, 4]


def test_search_closed_open_and_plain(spark, site):
    rules = site[0]
    held = {1: ("1", "2"), 2: ("2",), 4: ("3",)}
    pages = spark.createDataFrame(
        [(n, f"{H}/list/{n}", "".join(f'<a href="/e/{e}">x</a>' for e in links)) for n, links in held.items()],
        "page_id int, url string, html string",
    )
    templates = spark.createDataFrame(
        [(f"{H}/list/[1-4]", 4), (f"{H}/list/[1-]", 4), (f"{H}/list/4", 4)], "search string, last int"
    )
    rows = visits.search(templates, pages, rules).orderBy("page_no", "link").collect()
    found = {}
    for r in rows:
        found.setdefault(r["search"].rsplit("/", 1)[1], []).append((r["page_no"], r["link"].rsplit("/", 1)[1]))
    assert found == {"[1-4]": [(1, "1"), (1, "2"), (4, "3")], "[1-]": [(1, "1"), (1, "2")], "4": [(0, "3")]}


def test_search_pages_differ_by_query(spark, site):
    pages = spark.createDataFrame(
        [(n, f"{H}/list?page={n}#top", f'<noscript><a title="a>b" href="/e/{n}">x</a></noscript>') for n in (1, 2, 3)],
        "page_id int, url string, html string",
    )
    templates = spark.createDataFrame([(f"{H}/list?page=[1-3]", 3)], "search string, last int")
    rows = visits.search(templates, pages, site[0]).collect()
    assert sorted((r["page_no"], r["link"].rsplit("/", 1)[1]) for r in rows) == [(1, "1"), (2, "2"), (3, "3")]


def test_rule_that_needs_a_query_value(spark):
    rules = spark.createDataFrame(
        [(1, 1, "q", "a.example.com", ["https"], "episode", "^/v$", "id", "", None)], routing.RULE_SCHEMA
    )
    urls = [f"{H}/v?id=3", f"{H}/v?x=1&id=3", f"{H}/v?id=", f"{H}/v", f"{H}/v?xid=3"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: r["rule"] for r in visits.find_rule(df, rules).collect()}
    assert [got[u] for u in urls] == ["q", "q", None, None, None]
