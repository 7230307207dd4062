"""Operators on small cases, and ordered work against brute force with tiny blocks."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seriatim.functions import urls as U
from seriatim.operators import audit, chain, joins, links, listing, ordered, routing, status, watch
from seriatim.sources import crawl, sinks

RULES = [
    (1, 1, "one", "a.example.com", ["https"], "episode", "^/e/[0-9]+$", "", "House", None),
    (1, 2, "one", "a.example.com", ["https"], "series", "^/s/", "", "House", None),
    (2, 1, "two", "a.example.com", ["http", "https"], "episode", "^/", "id", "", "Own"),
    (3, 1, "three", "b.example.com", ["http"], "episode", "^/", "", "", None),
]


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(RULES, routing.RULE_SCHEMA)


def grouped(rows, key=0):
    held = {}
    for row in rows:
        held.setdefault(row[key], []).append(row)
    return held


@pytest.fixture(scope="module")
def series(spark):
    """One series holds most rows, positions have gaps, some are negative."""
    rng = random.Random(7)
    rows = []
    for s, size in (("hot", 300), ("cold", 7), ("one", 1)):
        for pos in sorted(rng.sample(range(-500, 2000), size)):
            rows.append((s, pos, pos * 10, rng.choice(["a", "b", None]), rng.random() < 0.3))
    df = spark.createDataFrame(rows, "s string, pos int, v int, k string, open boolean").repartition(5)
    return rows, df


SPAN = 17


def test_number_rows(series):
    rows, df = series
    outputs = {"n": ordered.place(), "size": ordered.size(), "top": ordered.whole(F.max, "v")}
    got = ordered.scan(df, ["s"], "pos", outputs, span=SPAN).collect()
    assert {(r["s"], r["top"]) for r in got} == {(s, g[-1][2]) for s, g in grouped(rows).items()}
    down = ordered.number_rows(df, ["s"], "pos", "n", descending=True, span=SPAN).collect()
    want = {(s, r[1]): (i + 1, len(g)) for s, g in grouped(rows).items() for i, r in enumerate(g)}
    assert {(r["s"], r["pos"]): (r["n"], r["size"]) for r in got} == want
    assert {(r["s"], r["pos"]): r["n"] for r in down} == {k: size - n + 1 for k, (n, size) in want.items()}


def test_neighbours_are_each_others_inverse(series):
    rows, df = series
    got = {(r["s"], r["v"]): r for r in ordered.neighbours(df, ["s"], "pos", "v", "b", "a", span=SPAN).collect()}
    for s, g in grouped(rows).items():
        values = [r[2] for r in g]
        for i, v in enumerate(values):
            assert got[s, v]["b"] == (values[i - 1] if i else None)
            assert got[s, v]["a"] == (values[i + 1] if i + 1 < len(values) else None)
    assert all(got[s, r["a"]]["b"] == v for (s, v), r in got.items() if r["a"] is not None)


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_carry(series, backward, inclusive):
    rows, df = series
    output = (ordered.known_after if backward else ordered.known_before)("k", inclusive=inclusive)
    got = ordered.scan(df, ["s"], "pos", {"out": output}, span=SPAN).collect()
    found = {(r["s"], r["pos"]): r["out"] for r in got}
    for s, g in grouped(rows).items():
        line = g[::-1] if backward else g
        last = None
        for r in line:
            if inclusive and r[3] is not None:
                last = r[3]
            assert found[s, r[1]] == last
            last = r[3] if r[3] is not None else last


def test_running_sum_and_islands(series):
    rows, df = series
    sums = {(r["s"], r["pos"]): r["out"] for r in ordered.scan(df, ["s"], "pos", {"out": ordered.running("v")}, span=SPAN).collect()}
    isles = {(r["s"], r["pos"]): r["out"] for r in ordered.islands(df, ["s"], "pos", "k", "out", span=SPAN).collect()}
    for s, g in grouped(rows).items():
        total = isle = 0
        before = None
        for i, r in enumerate(g):
            total += r[2]
            isle += i == 0 or r[3] is None or r[3] != before
            before = r[3]
            assert sums[s, r[1]] == total
            assert isles[s, r[1]] == isle


def test_range_blocks_number_like_a_sort(spark):
    rng = random.Random(3)
    rows = [("s", rng.choice([None, 0, 1, 5]), pos) for pos in range(500)]
    df = spark.createDataFrame(rows, "s string, key int, pos int")
    got = [r["pos"] for r in listing.by_site_key(df, ["s"], "key", "pos").orderBy("place").collect()]
    assert got == [r[2] for r in sorted(rows, key=lambda r: (r[1] or 0, -r[2]))]


def test_reading_order(spark):
    def placed(entries):
        rows = spark.createDataFrame([("s", u, lab, i) for i, (u, lab) in enumerate(entries)], "s string, u string, l string, pos int")
        return [r["u"] for r in listing.by_label_number(rows, ["s"], "u", "l", "pos").orderBy("place").collect()]

    assert placed([("c", "第3話"), ("a", "第１話"), ("b", "#2"), ("c", "第9話")]) == ["a", "b", "c"]
    assert placed([("c", "第3話"), ("a", "後編"), ("b", "#2")]) == ["b", "a", "c"]
    assert placed([("c", "1"), ("a", "1"), ("b", "#2")]) == ["b", "a", "c"]
    assert placed([("c", "x"), ("a", "y")]) == ["a", "c"]


def test_reversals_differ_with_duplicates(spark):
    rows = spark.createDataFrame([("s", u, i) for i, u in enumerate("abca")], "s string, u string, pos int")
    first = listing.newest_first(rows, ["s"], "u", "pos").orderBy("place").collect()
    last = listing.newest_first(rows, ["s"], "u", "pos", reverse_then_dedup=True).orderBy("place").collect()
    assert [r["u"] for r in first] == ["c", "b", "a"]
    assert [r["u"] for r in last] == ["a", "c", "b"]


def test_open_neighbours(spark):
    flags = [True, False, None, True, False, True]
    rows = [("s", i, i + 1, f) for i, f in enumerate(flags)] + [("t", i, i + 1, None) for i in range(3)]
    df = spark.createDataFrame(rows, "s string, pos int, n int, open boolean")
    got = listing.open_neighbours(df, ["s"], "pos", "n", "open", "b", "a").collect()
    near = {(r["s"], r["n"]): (r["b"], r["a"]) for r in got}
    assert [near["s", n] for n in range(1, 7)] == [(None, 4), (1, 4), (1, 4), (1, 6), (4, 6), (4, None)]
    assert [near["t", n] for n in range(1, 4)] == [(None, 2), (1, 3), (2, None)]


def test_around_number_is_strict(spark):
    shown = spark.createDataFrame([("s", 1, "a"), ("s", 3, "b"), ("s", 5, "c")], "s string, n int, item string")
    asked = spark.createDataFrame([("s", n, n) for n in (0, 1, 2, 3, 5, 6)], "s string, n int, probe int")
    got = listing.around_number(shown, asked, ["s"], "n", "item", "probe").collect()
    near = {r["probe"]: (r["before"], r["after"]) for r in got}
    assert near == {0: (None, "a"), 1: (None, "b"), 2: ("a", "b"), 3: ("a", "c"), 5: ("b", None), 6: ("c", None)}


def test_as_of(spark):
    starts = spark.createDataFrame(
        [("w", 1, "001", "s1"), ("w", 10, "010", "s10"), ("w", None, "ex", "sx")], "w string, n int, name string, start string"
    )
    pages = spark.createDataFrame(
        [("w", n, f"{n}", n) for n in (0, 1, 5, 10, 11)] + [("w", None, "ex", 100), ("w", None, "no", 101)],
        "w string, n int, name string, id int",
    )
    got = {r["id"]: r["start"] for r in joins.as_of(pages, starts, ["w"], "n", "name", "start").collect()}
    assert got == {0: None, 1: "s1", 5: "s1", 10: "s10", 11: "s10", 100: "sx", 101: None}


def test_routing(spark, rules):
    urls = [
        "https://a.example.com/e/1",
        "HTTPS://A.example.com:443/e/1",
        "http://a.example.com/e/1",
        "https://a.example.com/x?id=3",
        "https://www.a.example.com/e/1",
        "https://b.example.com/e/1",
        "http://b.example.com/e/1",
        "not a url",
        "",
    ]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: (r["rule"], r["kind"]) for r in routing.route(df, rules).collect()}
    assert [got[u] for u in urls] == [
        ("one", "episode"), ("one", "episode"), (None, None), ("two", "episode"), (None, None), (None, None),
        ("three", "episode"), (None, None), (None, None),
    ]
    ok = {r["url"]: r["suitable"] for r in routing.suitable(df, rules).collect()}
    assert [ok[u] for u in urls] == [True, True, True, True, False, False, True, False, False]
    house = {r["url"]: r["publisher"] for r in routing.publisher_of(df, rules).collect()}
    assert house[urls[0]] == "Own"
    assert house[urls[6]] == ""
    forced = routing.route_forced(df.withColumn("f", F.lit("two")), rules, "f").where("rule IS NOT NULL").collect()
    assert [r["url"] for r in forced] == ["https://a.example.com/x?id=3"]
    unknown = routing.route_forced(df.withColumn("f", F.lit("nine")), rules, "f")
    assert unknown.where("known").count() == 0


def test_downloadable_links(spark, rules):
    html = """<html><!-- <a href="/e/9">x</a> --><script>"<a href='/e/8'>"</script>
      <a href="/e/1">1</a> <a class=x href='e/2 '>2</a><A HREF=/e/3>3</A><a href="/e/1#top">again</a>
      <a name="n">no</a><a href="mailto:x@y">m</a><a href="https://other.example.com/e/1">o</a>
      <a href="#frag">self</a><a href="/e/5?id=1&amp;b=2">q</a></html>"""
    pages = spark.createDataFrame([(1, "https://a.example.com/", html)], "page_id int, url string, html string")
    got = links.downloadable_links(pages, rules).orderBy("pos").collect()
    assert [(r["link"].removeprefix("https://a.example.com"), r["rule"]) for r in got] == [
        ("/e/1", "one"), ("/e/2", "one"), ("/e/3", "one"), ("/e/5?id=1&b=2", "one"),
    ]


def test_numbered_pages(spark):
    urls = ["https://a/p[2-4]/x", "https://a/p[08-]", "https://a/p", "https://a/[4-2]", "https://a/[9-11]"]
    df = spark.createDataFrame([(u, 10) for u in urls], "url string, last int")
    got = links.expand_pages(df, "url", "last").orderBy("url", "page_no").collect()
    by_url = {u: [r["page_url"] for r in got if r["url"] == u] for u in urls}
    assert by_url[urls[0]] == ["https://a/p2/x", "https://a/p3/x", "https://a/p4/x"]
    assert by_url[urls[1]] == ["https://a/p08", "https://a/p09", "https://a/p10"]
    assert by_url[urls[2]] == ["https://a/p"]
    assert by_url[urls[3]] == []
    assert by_url[urls[4]] == ["https://a/9", "https://a/10", "https://a/11"]
    assert {r["url"] for r in got if r["open_ended"]} == {urls[1]}


def test_ranges_that_name_the_same_pages_lie_side_by_side(spark):
    starts = [1, 499, 500, 501, 9999, 10000, 10001, 10400]
    df = spark.createDataFrame([(f"https://a/p[{n}-]", 10501) for n in starts], "url string, last int")
    rows = links.expand_pages(df, "url", "last").select("*", F.spark_partition_id().alias("part")).collect()
    assert sorted((r["url"], r["page_url"]) for r in rows) == sorted(
        (f"https://a/p[{n}-]", f"https://a/p{k}") for n in starts for k in range(n, 10502)
    )
    blocks = [(r["part"], r["page_no"] // links.PAGES_AT_ONCE) for r in rows]
    runs = 1 + sum(a != b for a, b in zip(blocks, blocks[1:]))
    assert runs == len(set(blocks))


def test_a_page_that_several_ranges_name_lies_in_one_place(spark, monkeypatch):
    monkeypatch.setattr(links, "ROWS_PER_TASK", 100, raising=False)
    urls = [*(f"https://a/p[{n}-]" for n in (1, 1, 700, 2000, 30001)), "https://a/p[3-5]", "https://a/p[0003-4]", "https://a/p", None, None]
    df = spark.createDataFrame([(n, u, 30500) for n, u in enumerate(urls)], "url int, search string, last int")
    got = links.expand_pages(df, "search", "last").select("*", F.spark_partition_id().alias("part")).collect()
    want = [(n, f"https://a/p{k}") for n, u in enumerate(urls[:5]) for k in range(int(u[12:-2]), 30501)]
    want += [(5, f"https://a/p{k}") for k in (3, 4, 5)] + [(6, "https://a/p0003"), (6, "https://a/p0004"), (7, "https://a/p")]
    assert sorted((r["url"], r["page_url"]) for r in got if r["url"] < 8) == sorted(want)
    assert sorted((r["url"], r["page_url"], r["ranged"], r["open_ended"]) for r in got if r["url"] > 6) == [
        (7, "https://a/p", False, False), (8, None, False, False), (9, None, False, False),
    ]
    whole = [(r["part"], r["page_no"]) for r in got if r["url"] < 2]
    assert 1 + sum(a != b for a, b in zip(whole, whole[1:])) == len(set(whole))
    pages = Counter(part for part, _ in set((r["part"], r["page_url"]) for r in got))
    assert max(pages.values()) <= links.STRETCHES_PER_TASK * links.PAGES_AT_ONCE


def test_many_ranges_of_one_stretch_are_several_lists(spark, monkeypatch):
    monkeypatch.setattr(links, "RANGES_AT_ONCE", 2)
    df = spark.createDataFrame([(n, "https://a/p[1-3]" if n else "https://a") for n in range(40)], "n int, url string")
    got = links.expand_pages(df.withColumn("last", F.lit(9)), "url", "last").collect()
    assert sorted((r["n"], r["page_no"] or 0) for r in got) == [(0, 0), *((n, k) for n in range(1, 40) for k in (1, 2, 3))]


def test_paginate(spark):
    closed = [(1, False, ["a", "b"]), (2, False, []), (3, True, ["z"]), (4, False, ["b", "c"])]
    opened = [(1, False, ["a"]), (2, False, ["a", "b"]), (3, False, ["b"]), (4, False, ["c"])]

    def read(held, **kind):
        pages = spark.createDataFrame([("g", n, f) for n, f, _ in held], "g string, n int, failed boolean")
        rows = [("g", n, i, link) for n, _, found in held for i, link in enumerate(found)]
        found = spark.createDataFrame(rows, "g string, n int, pos int, link string")
        got = links.paginate(pages, found, ["g"], "n", "failed", **kind)
        return [(r["n"], r["link"]) for r in got.orderBy("n", "pos").collect()]

    assert read(closed, open_ended=False) == [(1, "a"), (1, "b"), (4, "c")]
    assert read(closed, open_ended=True) == [(1, "a"), (1, "b")]
    assert read(opened, open_ended=True) == [(1, "a"), (2, "b")]


def test_listing_end(spark):
    rows = [("short", n, c, 0, 99) for n, c in enumerate((3, 3, 2, 3))]
    rows += [("total", n, 3, 6, 99) for n in range(4)] + [("pager", n, 3, 0, 1) for n in range(3)]
    rows += [("max", n, 3, 0, 99) for n in range(9)]
    pages = spark.createDataFrame(rows, "g string, n int, c int, total int, last int")
    got = links.listing_end(pages, ["g"], "n", "c", page_size=3, total="total", last_page="last", max_pages=5)
    assert {r["g"]: r["count"] for r in got.groupBy("g").count().collect()} == {"short": 3, "total": 2, "pager": 1, "max": 5}


def test_labels(spark):
    rows = [("u", "", 0), ("u", "[見開き]", 1), ("u", "one", 2), ("u", "two!", 3), ("v", "", 4), ("w", "ab", 5), ("w", "cd", 6)]
    df = spark.createDataFrame(rows, "link string, text string, pos int")
    first = {r["link"]: r["label"] for r in links.first_label(df, ["link"], "text", ["pos"], ("[見開き]",)).collect()}
    longest = {r["link"]: r["label"] for r in links.longest_label(df, ["link"], "text", ["pos"]).collect()}
    assert first == {"u": "one", "v": "", "w": "ab"}
    assert longest == {"u": "[見開き]", "v": "", "w": "ab"}


def test_captions(spark):
    rows = [("b", 0, "x", None), ("b", 1, None, "C1"), ("b", 2, "y", None), ("b", 3, None, "C2"), ("b", 4, "y", None), ("b", 5, "z", None)]
    df = spark.createDataFrame(rows, "b string, pos int, link string, caption string")
    got = {r["link"]: r["caption"] for r in listing.captions(df, ["b"], "pos", "link", "caption").collect()}
    assert got == {"x": "", "y": "C1", "z": "C2"}


CHAIN = [("1", None, "2"), ("2", "1", "3"), ("3", "2", "4"), ("4", "3", None)]


def walked(spark, edges, start, **kind):
    df = spark.createDataFrame(edges, "url string, prev string, next string")
    seeds = spark.createDataFrame([(start,)], "start string")
    if kind.pop("both", False):
        rows = chain.both_ways(df, seeds, "url", "prev", "next", "start").orderBy("depth").collect()
    else:
        rows = chain.walk(df, seeds, "url", "next", "start").orderBy("depth").collect()
    return [r["url"] for r in rows]


def test_walk(spark):
    assert walked(spark, CHAIN, "2") == ["2", "3", "4"]
    assert walked(spark, CHAIN, "4") == ["4"]
    assert walked(spark, CHAIN, "gone") == []
    assert walked(spark, CHAIN[:2] + CHAIN[3:], "1") == ["1", "2"]
    loop = [*CHAIN[:3], ("4", "3", "2")]
    assert walked(spark, loop, "1") == ["1", "2", "3", "4"]
    assert walked(spark, [("1", None, "1")], "1") == ["1"]


def test_walk_both_ways(spark):
    assert walked(spark, CHAIN, "3", both=True) == ["1", "2", "3", "4"]
    loop = [("1", "4", "2"), ("2", "1", "3"), ("3", "2", "4"), ("4", "3", "1")]
    assert walked(spark, loop, "3", both=True) == ["4", "1", "2", "3"]
    half = [("1", None, "2"), ("2", "1", "3"), ("3", "2", "1")]
    assert walked(spark, half, "2", both=True) == ["1", "2", "3"]


def test_long_walks_match_listing_places(spark):
    n = 300
    edges = [(i, i + 1 if i + 1 < n else 150) for i in range(n)]
    df = spark.createDataFrame(edges, "node int, next int")
    seeds = spark.createDataFrame([(0,), (200,)], "seed int")
    rows = chain.walk(df, seeds, "node", "next", "seed").collect()
    got = {(r["seed"], r["node"]): r["depth"] for r in rows}
    assert {k: v for k, v in got.items() if k[0] == 0} == {(0, i): i for i in range(n)}
    tail = [*range(200, 300), *range(150, 200)]
    assert {k: v for k, v in got.items() if k[0] == 200} == {(200, v): d for d, v in enumerate(tail)}
    assert {r["node"] for r in chain.in_cycles(df, "node", "next").collect()} == set(range(150, 300))


def test_link_audit(spark):
    edges = [("1", None, "2"), ("2", "1", "9"), ("3", None, "2")]
    df = spark.createDataFrame(edges, "url string, prev string, next string")
    found = {tuple(r) for r in chain.link_audit(df, "url", "prev", "next").collect()}
    assert found == {("2", "9", "dangling"), ("3", "2", "one-way")}


def test_summary(spark):
    rows = []
    for work, states in {
        "mixed": ["saved", "saved", "exists", "locked"],
        "there": ["exists", "locked"],
        "shut": ["locked", "locked"],
        "one": ["saved"],
        "skipped": ["exists"],
        "shut one": ["locked"],
    }.items():
        rows += [(work, f"t{n}", s) for n, s in enumerate(states)]
    df = spark.createDataFrame(rows, "work string, title string, status string")
    folders = df.select("work", F.concat(F.lit("d/"), F.col("work")).alias("folder")).distinct()
    told = status.summarise(df, folders, ["work"], "title", "folder", "status").collect()
    got = {r["work"]: (r["level"], r["message"]) for r in told}
    assert got == {
        "mixed": ("info", "saved: d/mixed (2 episodes, 1 skipped, 1 locked)"),
        "there": ("info", "skipped: d/there (1 episodes, 1 locked)"),
        "shut": ("warning", "locked: d/shut (2 episodes)"),
        "one": ("info", "saved: d/one/t0"),
        "skipped": ("info", "skipped: d/skipped/t0"),
        "shut one": ("warning", "skip: 't0' needs a purchase, a wait or a login."),
    }


def test_nothing_readable_counts_empty_works(spark):
    works = spark.createDataFrame([("a",), ("b",), ("c",)], "work string")
    results = spark.createDataFrame([("a", "locked"), ("b", "locked"), ("b", "saved")], "work string, status string")
    got = status.nothing_readable(works, results, ["work"], "status").collect()
    assert sorted(r["work"] for r in got) == ["a", "c"]


def patrolled(spark, entries, edges, episodes):
    watched = spark.createDataFrame(entries, "pos bigint, url string, title string, search boolean, chain boolean")
    links_ = spark.createDataFrame(edges, "url string, next_url string")
    states = spark.createDataFrame(episodes, "url string, series_title string, status string")
    return [tuple(r) for r in watch.patrol(watched, links_, states).orderBy("pos").collect()]


def test_patrol(spark):
    edges = [("1", "2"), ("2", "3"), ("3", None), ("x", "y"), ("y", None)]
    episodes = [("1", "A", "saved"), ("2", "A", "locked"), ("3", "B", "saved"), ("x", "X", "locked"), ("y", "X", "locked")]
    entries = [
        (1, "1", "old", False, True),
        (2, "x", "X", False, True),
        (3, "gone", "G", False, True),
        (4, "series", "S", False, False),
        (5, "page[1-]", "", True, False),
        (6, "3", "", False, True),
    ]
    assert patrolled(spark, entries, edges, episodes) == [
        (1, "2", "B", False),
        (2, "x", "X", False),
        (3, "gone", "G", False),
        (4, "series", "S", False),
        (5, "page[1-]", "", True),
        (6, "3", "B", False),
    ]


def test_upsert(spark):
    before = spark.createDataFrame(
        [(1, "a", "A", False), (2, "b", "B", True), (3, "a", "again", False)], "pos bigint, url string, title string, search boolean"
    )
    updates = spark.createDataFrame(
        [
            (1, "a2", "a", "", False),
            (2, "b", None, "B2", False),
            (3, "new", "nowhere", "N", True),
            (4, "newer", None, "M", False),
            (5, "new", None, "N2", True),
        ],
        "seq bigint, url string, replacing string, title string, search boolean",
    )
    got = [tuple(r) for r in watch.upsert(before, updates).orderBy("pos").collect()]
    assert got == [
        (1, "a2", "A", False),
        (2, "b", "B2", False),
        (3, "a", "again", False),
        (4, "new", "N2", True),
        (5, "newer", "M", False),
    ]


def test_audit(spark, rules):
    watched = spark.createDataFrame(
        [(1, "https://a.example.com/e/1", False), (2, "https://a.example.com/e/1", False), (3, "https://no/", False), (4, "https://no/", True)],
        "pos int, url string, search boolean",
    )
    assert [r["pos"] for r in audit.listed_again(watched, "url", "pos").orderBy("pos").collect()] == [2, 4]
    assert [r["pos"] for r in audit.unroutable(watched, rules, "url", "search").collect()] == [3]
    publishers = spark.createDataFrame([("a.example.com", "P"), ("stray.example.com", "Q")], "host string, publisher string")
    gaps = {tuple(r) for r in audit.registry_gaps(rules, publishers, watched.select("url")).collect()}
    assert gaps == {
        ("b.example.com", "no publisher"), ("stray.example.com", "unknown host"), ("b.example.com", "no sample routed"),
    }
    flags = spark.range(1).select(
        *[audit.is_permutation(F.array(*map(F.lit, held))).alias(f"c{n}") for n, held in enumerate(([1, 0, 2], [1, 1, 0], [0], [1, 2, 3]))]
    )
    assert tuple(flags.first()) == (True, False, True, False)


def test_file_names(spark):
    def names(count, **kind):
        pages = spark.createDataFrame([("e", n) for n in range(count)], "e string, pos int")
        return [r["file_name"] for r in sinks.page_manifest(pages, "e", "pos", **kind).orderBy("page_index").collect()]

    assert names(3) == ["0.jpg", "1.jpg", "2.jpg"]
    assert (names(10)[0], names(11)[-1]) == ("00.jpg", "10.jpg")
    assert names(11, only_first=True) == ["0.jpg"]


def test_works_catalogue(spark, tmp_path):
    lines = [
        "タイトル,著者1,著者2,著者3,クレジット1,クレジット2,クレジット3",
        '作A,甲,乙,,原作,,',
        '作B,,,,原作,,',
        '"作,C",丙,,,,,',
        '作A,丁,,,作画,,',
        ',戊,,,,,',
    ]
    (tmp_path / "works.csv").write_text("\n".join(lines), encoding="utf-8")
    got = crawl.catalogue_credits(crawl.works_catalogue(spark, str(tmp_path / "works.csv")))
    assert {r["title"]: r["credits"] for r in got.collect()} == {"作A": "丁 (作画)", "作,C": "丙"}


def test_feeds_and_documents(spark):
    xml = "<rss><channel><item><link> https://a/1?x#y </link></item><item><link></link></item><item><link>https://a/2</link></item></channel></rss>"
    feeds = spark.createDataFrame([(1, xml), (2, "broken"), (3, None)], "id int, xml string")
    assert [tuple(r) for r in crawl.feed_listing(feeds, "xml", cut_query=True).orderBy("pos").collect()] == [
        (1, "https://a/1", 1), (1, "https://a/2", 2),
    ]
    body = (
        '{"data": [{"id": "2", "type": "episode", "attributes": {"sort_volume": 7, "title": "t"}}, {"id": "3", "type": "episode"},'
        ' {"id": "4", "attributes": {"title": "no order"}}], "included": [{"id": "9", "type": "author"}, {"id": "8", "type": "comic", "attributes": {"name": "w"}}]}'
    )
    docs = spark.createDataFrame([(1, body), (2, "{"), (3, None)], "id int, body string")
    rows = crawl.json_api(docs, "body", "comic", "sort_volume").collect()
    assert [(r["id"], r["episode_id"], r["order_no"], r["work_id"], r["work"]["name"]) for r in rows] == [(1, "2", 7, "8", "w")]


def test_nested_chapters(spark):
    chapters = [(["a", "b"], None), (["c"], "x"), (None, "y"), ([], None)]
    df = spark.createDataFrame([(1, chapters)], "id int, chapters array<struct<episodes:array<string>,extra:string>>")
    got = crawl.chapter_entries(df, "chapters").orderBy("chapter", "place").collect()
    assert [(r["chapter"], r["place"], r["entry"]) for r in got] == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (2, 2, "x"), (3, 1, "y")]


def test_embedded_json(spark):
    html = """<script id="comic-data" type="application/json">{"a": 1}</script><div data-value='{"b": 2}'></div>
    <div data-other="{&quot;c&quot;: 3}"></div><script>const list = [{"d": 4}];</script>"""
    df = spark.createDataFrame([(html,), ('<script id="comic-data">{broken</script>',), ("",)], "html string")
    h = F.col("html")
    got = df.select(
        F.try_variant_get(crawl.script_json(h, "comic-data"), "$.a", "int"),
        F.try_variant_get(crawl.attribute_json(h, "data-value"), "$.b", "int"),
        F.try_variant_get(crawl.attribute_json(h, "data-other"), "$.c", "int"),
        F.try_variant_get(crawl.assigned_json(h, "list"), "$[0].d", "int"),
    ).collect()
    assert [tuple(r) for r in got] == [(1, 2, 3, 4), (None,) * 4, (None,) * 4]


def test_same_page(spark):
    assert spark.range(1).select(U.same_page(F.lit("https://a/b/"), F.lit("https://a/b"))).first()[0]


def test_links_of_the_own_work_and_of_a_shape(spark):
    html = (
        '<ul><li><a href="/w1/2.html">a</a></li><li><a href="http://b.example.com/w1/3.html">b</a></li>'
        '<li><a href="/w2/1.html">c</a></li></ul><a href="/w1/4.html?p=1">d</a><a href="/w1/4.html#x">d</a><a href="/w1/">e</a>'
    )
    df = spark.createDataFrame([("https://a.example.com/w1/list.html", html), ("https://a.example.com/", html), (None, None)], "url string, html string")
    own = links.own_work_links(df, "ul", "^/([^/]+)/[0-9]+[.]html$").collect()
    assert [(r.pos, r.link) for r in own] == [(1, "https://a.example.com/w1/2.html"), (2, "http://b.example.com/w1/3.html")]
    shaped = links.shaped_links(df.limit(1), "^/w1/[0-9]+[.]html$").orderBy("pos").collect()
    assert [r.link.split("/", 3)[3] for r in shaped] == ["w1/2.html", "w1/3.html", "w1/4.html"]
    assert [r.pos for r in shaped] == [1, 2, 3]


def test_walk_stays_inside_an_episode(spark):
    rows = [(1, 2, "a"), (2, 3, "a"), (3, 4, "b"), (4, 5, None), (5, 6, None), (6, 4, None), (7, 8, "c"), (8, None, "c"), (9, 99, "d")]
    df = spark.createDataFrame(rows, "n bigint, next bigint, title string")
    starts = spark.createDataFrame([(1,), (3,), (4,), (7,), (8,)], "s bigint")
    inside = chain.links_inside(df, "n", "next", "title", starts)
    assert inside.count() == len(rows) and inside.columns == df.columns
    walked = chain.walk(inside, starts, "n", "next", "s").collect()
    assert {(r.s, r.n) for r in walked} == {(1, 1), (1, 2), (3, 3), (4, 4), (4, 5), (4, 6), (7, 7), (8, 8)}
    free = {(r.n, r.next) for r in chain.links_inside(df, "n", "next", "title").collect()}
    assert (2, None) in free and (3, None) in free and (6, 4) in free and (9, 99) in free and (7, 8) in free


def test_rules_of_forms(spark):
    forms = [
        ("https://a.example.com/w/<work id>/e.p<n>.html", "episode"),
        ("http://a.example.com/w/<work>/", "series"),
        ("https://a.example.com/read?id=<id>&x=<x>", "viewer"),
        ("https://a.example.com/", "top"),
    ]
    rows = [(1, n, "one", kind, form, "House", None) for n, (form, kind) in enumerate(forms)]
    names = "priority int, form int, rule string, kind string, url_form string, publisher string, host_publisher string"
    table = routing.rules_of_forms(spark.createDataFrame(rows, names))
    want = {
        "http://A.example.com/w/7/e.p12.html": "episode",
        "https://a.example.com/w/7/e.p12.html/?q": "episode",
        "https://a.example.com/w/7/exp12.html": None,
        "https://a.example.com/w/7": "series",
        "https://a.example.com/w/7/8": None,
        "https://a.example.com/read?x=1&id=5": "viewer",
        "https://a.example.com/read?x=1": None,
        "https://a.example.com": "top",
        "ftp://a.example.com/": None,
    }
    urls = spark.createDataFrame([(u,) for u in want], "url string")
    got = {r.url: r.kind for r in routing.route(urls, routing.register_rules(table)).collect()}
    assert got == want
