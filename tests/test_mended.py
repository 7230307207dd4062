"""Links, numbers, watch-list titles and stream sources that once were lost or changed."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from seriatim.functions import text as T
from seriatim.operators import links, listing, watch
from seriatim.streaming import batches


@pytest.mark.parametrize(
    "markup, want",
    [
        ('<noscript><a href="/1">x</a></noscript>', ["/1"]),
        ('<a href="/q?x=1&#038;y=2&amp;z=&#x27;">x</a>', ["/q?x=1&y=2&z='"]),
        ('<a title="a>b" href="/3">x</a><a data-href="/no" href=/4>y</a>', ["/3", "/4"]),
        ("<a class=x disabled\n href='/5'>x</a><a name=y>z</a>", ["/5"]),
        ('<!-- <a href="/6">x</a> --><script><a href="/7">x</a></script>', []),
        ('<a href="/&eacute;&#233;&nosuch;&#9999999;&#xD800;&">x</a>', ["/éé&nosuch;&#9999999;&#xD800;&"]),
        ('<a href="&amp;#38;&#38;lt;">x</a>', ["&#38;&lt;"]),
    ],
)
def test_hrefs(spark, markup, want):
    df = spark.createDataFrame([(markup,)], "html string")
    assert df.select(links.hrefs(F.col("html")).alias("h")).first()["h"] == want


def test_anchor_text_and_every_block(spark):
    html = '<nav title=">"><a href="/1" title="2>1">a &gt; b</a></nav>x<nav><a href="/2"><b class="x>">c</b></a></nav><a href="/3">d</a>'
    df = spark.createDataFrame([("https://a.b/", html)], "url string, html string")
    found = df.select(links.anchors(F.col("html")).alias("a")).first()["a"]
    assert [(a.href, a.text) for a in found] == [("/1", "a > b"), ("/2", "c"), ("/3", "d")]
    got = links.page_links(df, within="nav").orderBy("pos").collect()
    assert [r.link for r in got] == ["https://a.b/1", "https://a.b/2"]


def test_long_markup_is_no_trouble(spark):
    html = "<a " + " ".join(f'data-{n}="{n}>"' for n in range(3000)) + ' href="/far">x</a>' + "<a " * 3000
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(links.hrefs(F.col("html")).alias("h")).first()["h"] == ["/far"]


def test_wide_digits(spark):
    df = spark.createDataFrame([("１２",), (" 7　",), ("-3",), ("1.5",)], "t string")
    assert [r.n for r in df.select(T.positive_int(F.col("t")).alias("n")).collect()] == [12, 7, None, None]
    key = df.select(listing.name_key(F.lit("jk０２")).alias("k")).first()["k"]
    assert (key.letters, key.number, key.rest) == ("jk", 2.0, "")


def test_an_empty_title_never_overwrites(spark):
    held = spark.createDataFrame([(1, "u1", "old", False)], "pos bigint, url string, title string, search boolean")
    updates = spark.createDataFrame(
        [(1, "u1", None, "new", False), (2, "u1", None, "", True), (3, "u2", None, "first", False), (4, "u2", None, "", False)],
        "seq bigint, url string, replacing string, title string, search boolean",
    )
    got = {r.url: (r.pos, r.title, r.search) for r in watch.upsert(held, updates).collect()}
    assert got == {"u1": (1, "new", True), "u2": (2, "first", False)}


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_reads_what_batch_reads(spark, tmp_path, parts):
    path = str(tmp_path / "events.parquet")
    spark.range(10).repartition(parts).write.parquet(path)
    spark.range(5).write.parquet(str(tmp_path / "events_old.parquet"))
    stream = batches.landed_stream(spark, str(tmp_path), "events", spark.read.parquet(path).schema, files_per_batch=1)
    seen = []
    batches.run_available(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "checkpoint"))
    assert sum(seen) == 10 and len(seen) == parts
