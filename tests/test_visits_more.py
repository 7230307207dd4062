"""Moves of a watch list, whole patrols, reported failures, first-ever items, shared tables."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from seriatim import visits
from seriatim.functions import dates, urls
from seriatim.operators import chain, listing, links, watch
from seriatim.sources import crawl, shared
from seriatim.streaming import batches, news

UPDATE = "seq bigint, url string, replacing string, title string, search boolean"
ENTRY = "pos bigint, url string, title string, search boolean"


def test_moves_follow_each_other(spark):
    held = spark.createDataFrame([(1, "u1", "One", False), (2, "v1", "Two", False)], ENTRY)
    updates = spark.createDataFrame(
        [
            (1, "u2", "u1", "", False),
            (2, "w1", None, "W", False),
            (3, "u3", "u2", "Three", False),
            (4, "w2", "w1", "", False),
            (5, "u4", "u3", "", False),
            (6, "w2", None, "", False),
            (7, "z", "nowhere", "", True),
        ],
        UPDATE,
    )
    got = [tuple(r) for r in watch.upsert(held, updates).orderBy("pos").collect()]
    assert got == [(1, "u4", "Three", False), (2, "v1", "Two", False), (3, "w2", "W", False), (4, "z", "", True)]


def test_no_updates(spark):
    held = spark.createDataFrame([(1, "u1", "One", False)], ENTRY)
    assert [tuple(r) for r in watch.upsert(held, spark.createDataFrame([], UPDATE)).collect()] == [(1, "u1", "One", False)]


def test_patrol_visits_series(spark):
    watched = spark.createDataFrame(
        [(1, "s1", "", False, False), (2, "s2", "kept", False, False), (3, "s3", "", False, False), (4, "q", "", True, False)],
        ENTRY + ", chain boolean",
    )
    edges = spark.createDataFrame([], "url string, next_url string")
    episodes = spark.createDataFrame(
        [("a", "A", "locked"), ("b", "B", "exists"), ("c", "C", "locked")], "url string, series_title string, status string"
    )
    listed = spark.createDataFrame(
        [("s1", 1, "a"), ("s1", 2, "b"), ("s1", 3, "a"), ("s2", 1, "c")], "series_url string, pos bigint, episode_url string"
    )
    got = [tuple(r) for r in watch.patrol(watched, edges, episodes, listed).orderBy("pos").collect()]
    assert got == [(1, "s1", "B", False), (2, "s2", "kept", False), (3, "s3", "", False), (4, "q", "", True)]


def test_ends(spark):
    edges = spark.createDataFrame([(n, n - 1 if n % 10 else None) for n in range(40)], "n bigint, to bigint")
    assert {r["n"]: r["end"] for r in chain.ends(edges, "n", "to", "end").collect()} == {n: n // 10 * 10 for n in range(40)}


def test_walks_of_any_shape(spark):
    """Chains, loops with and without a way in, of lengths around powers of two."""
    to, seeds = {}, []
    for size in (1, 2, 3, 4, 5, 7, 8, 9, 16, 17):
        for back in sorted({None, 0, size // 2, size - 1}, key=str):
            names = [f"{size}-{back}-{n}" for n in range(size)]
            to |= dict(zip(names, [*names[1:], None if back is None else names[back]]))
            seeds += [names[0], names[-1]]
    edges = spark.createDataFrame(list(to.items()), "node string, link string")
    asked = spark.createDataFrame([(s, None) for s in seeds], "seed string, note string").distinct()
    want = set()
    for seed in seeds:
        at, depth, seen = seed, 0, set()
        while at is not None and at not in seen:
            want.add((seed, at, depth))
            seen.add(at)
            at, depth = to[at], depth + 1
    got = [(r["seed"], r["node"], r["depth"]) for r in chain.walk(edges, asked, "node", "link", "seed").collect()]
    assert len(got) == len(want) and set(got) == want


def test_one_number_over_many_blocks(spark):
    shown = spark.createDataFrame([("s", 1, 10), ("s", 2, 20), ("s", 2, 21), ("s", 3, 30)], "s string, n int, item int")
    asked = spark.range(5000).select(F.lit("s").alias("s"), F.lit(2).alias("n"), F.col("id").alias("probe"))
    near = listing.around_number(shown, asked, ["s"], "n", "item", "probe")
    assert near.groupBy("before", "after").count().collect() == [(10, 30, 5000)]


def test_visit_reports_failures(spark):
    rules = [(1, "one", 0, "a.example", ["https"], "^/e/.*$", "", "episode"), (1, "one", 1, "a.example", ["https"], "^/s/.*$", "", "series")]
    columns = "priority int, rule string, form int, host string, schemes array<string>, path_regex string, query_key string, kind string"
    table = spark.createDataFrame(rules, columns)
    site = "https://a.example"
    urls = spark.createDataFrame([(f"{site}/s/1",), (f"{site}/s/2",), (f"{site}/e/9",), ("https://other/",)], "url string")
    listed = spark.createDataFrame([(f"{site}/s/1", 1, f"{site}/e/1"), (f"{site}/s/1", 2, f"{site}/e/2")], "series_url string, pos bigint, episode_url string")
    edges = spark.createDataFrame([], "url string, prev_url string, next_url string")
    episodes = spark.createDataFrame([(f"{site}/e/1", "T", "E", "saved")], "url string, series_title string, episode_title string, status string")
    seen = visits.visit(urls, table, listed, edges, episodes, report=True)
    assert {(r["url"].removeprefix(site), r["status"]) for r in seen.collect()} == {
        ("/e/1", "saved"), ("/e/2", "failed"), ("/s/2", "failed"), ("/e/9", "failed"), ("https://other/", "unrouted"),
    }


def test_first_seen_never_forgets(spark, tmp_path):
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    for n, rows in enumerate([[(1, 1), (1, 1), (None, 2)], [(1, 1), (None, 2), (3, 3)], [(3, 3), (4, 4)]]):
        spark.createDataFrame(rows, "a bigint, b bigint").coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
        stream = spark.readStream.schema("a bigint, b bigint").parquet(f"{tmp_path}/in*")
        news.first_seen(stream, ["a", "b"], table, checkpoint)
    got = news.seen(spark, table, stream.schema).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 1), (3, 3), (4, 4), (None, 2)]


def test_dates(spark):
    told = {
        "20250821": "2025-08-21",
        "20250821T233000Z": "2025-08-22",
        "2025-08-21T23Z": "2025-08-22",
        "Thu, 21 Aug 2025 12:00:00 EST": "2025-08-22",
        "Thu, 21 Aug 2025 20:00:00 -0000": "2025-08-21",
        "Thu, 21 Aug 2025 20:00:00 GMT": "2025-08-22",
        "21 Aug 25 01:00:00 GMT": "2025-08-21",
        "21 Aug 99 01:00:00 GMT": "1999-08-21",
        "2025-0821": None,
    }
    df = spark.createDataFrame([(t,) for t in told], "t string")
    got = {r["t"]: r["d"] and r["d"].isoformat() for r in df.select("t", dates.japan_day(F.col("t")).alias("d")).collect()}
    assert got == told


def test_scripts(spark):
    page = '<script data-id="x">{"n":1}</script><script id="x">{"n":2}</script><script>var a = [["];", "\\"]; "], 3]; b = 1</script>'
    df = spark.createDataFrame([(page,), ("var a = [" + "1," * 200_000 + "1];",)], "html string")
    got = df.select(
        F.to_json(crawl.script_json(F.col("html"), "x")).alias("x"), F.length(F.to_json(crawl.assigned_json(F.col("html"), "a"))).alias("a")
    ).collect()
    assert got[0]["x"] == '{"n":2}' and got[0]["a"] == len('[["];","\\"]; "],3]') and got[1]["a"] == 400_003


def test_search_keeps_to_one_rule(spark):
    found = spark.createDataFrame([(1, 1, "x", "one"), (2, 1, "x", "two")], "page_no int, pos int, link string, rule string")
    fresh = links.fresh_links(found.withColumn("g", F.lit(1)), ["g"], "page_no", keep=["rule"]).collect()
    assert [(r["page_no"], r["rule"]) for r in fresh] == [(1, "one")]


def test_shared_tables_go(spark):
    table = shared.written(spark.range(3), "kept")
    path = table.inputFiles()[0].removeprefix("file:").replace("//", "/")
    assert os.path.exists(path)
    shared.discard(table)
    assert not os.path.exists(path)
    other = shared.written(spark.range(3), "kept").inputFiles()[0].removeprefix("file:").replace("//", "/")
    assert shared.cleanup(spark) > 0 and not os.path.exists(other)


def test_article_blocks(spark):
    bodies = {
        '<p><img src="1"><img src="2"></p><p>said</p><figure><img src="3"/></figure>': (3, 4),
        '<p><img class="emoji" src="e"></p><p><img src="1"></p><p>text <img src="2"></p>': (1, 0),
        '<p>long text</p><div class="wide comic-image"><img src="1"><img src="2"></div><p><img src="3"></p>': (2, 0),
        '<img src="1"><p>ab</p><noscript><img src="9"></noscript><img src="">': (1, 0),
        '<div><div><img src="1"></div><img src="2"></div>bare text<div><div><img src="3"></div> said </div><img src="4">': (3, 13),
        '<div><p><img src="1"></div>ab &amp; c</p><p> d <b>e</b> <img src="2"/>': (1, 0),
        '<img src="1"></div></p>a<br>b<section><div class="comic-image"><div><img src="2"></div><img src="3"></div><img src="4"></section>': (2, 0),
        '<img src="1"><div>one<div>two</div></div><ul><li>x<li>y</ul>z<img src="2"><div>open': (2, 9),
        '<img alt="a > b" src="1"><!-- <p>no</p> --><p>1 < 2</p><img src="2">': (2, 5),
        "": (0, 0),
    }
    df = spark.createDataFrame([(b,) for b in bodies], "html string")
    got = {r["html"]: tuple(r["own"]) for r in df.select("html", links.own_pages(links.article_blocks(F.col("html"))).alias("own")).collect()}
    assert got == bodies


def test_single_url_rules(spark):
    told = {"https://a/e/1.json": "https://a/e/1", "https://a/e/1.html": "https://a/e/1.html", "https://a/e/1.json/": "https://a/e/1.json/"}
    df = spark.createDataFrame([(u,) for u in told], "u string")
    assert {r["u"]: r["c"] for r in df.select("u", urls.drop_suffix(F.col("u"), ".json").alias("c")).collect()} == told
    assert df.select(urls.drop_slashes(F.lit("https://a/e//")).alias("c")).first()["c"] == "https://a/e"
