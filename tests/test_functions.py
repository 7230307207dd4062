"""Column functions on the edge cases they must get right."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from seriatim.functions import dates as D
from seriatim.functions import text as T
from seriatim.functions import urls as U
from seriatim.operators import links, listing, status

DAY = datetime.date


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def each(spark, values, function, kind="string"):
    """``function`` over a column of values, in their order."""
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {kind}")
    return [r["out"] for r in rows.select("n", function(F.col("v")).alias("out")).orderBy("n").collect()]


def test_japan_day_of_text(spark):
    cases = {
        "2026-09-20T15:00:00Z": DAY(2026, 9, 21),
        "2026-09-20T14:59:59Z": DAY(2026, 9, 20),
        "2026-09-20T23:00:00+09:00": DAY(2026, 9, 20),
        "2026-09-20T23:00:00-05:00": DAY(2026, 9, 21),
        "2026-09-20T23:59:59": DAY(2026, 9, 20),
        "2026-09-20 15:00:00.123Z": DAY(2026, 9, 21),
        "2026-09-21": DAY(2026, 9, 21),
        "2026/9/1": DAY(2026, 9, 1),
        "2026.09.21": DAY(2026, 9, 21),
        "2026年9月21日": DAY(2026, 9, 21),
        "２０２６年９月２１日": DAY(2026, 9, 21),
        "Thu, 21 Aug 2025 08:16:41 GMT": DAY(2025, 8, 21),
        "Thu, 21 Aug 2025 18:16:41 GMT": DAY(2025, 8, 22),
        "21 Aug 2025 18:16:41 +0900": DAY(2025, 8, 21),
        "更新日：2026/09/21 12:00": DAY(2026, 9, 21),
        " 2026-09-21　": DAY(2026, 9, 21),
        "": None,
        "soon": None,
        "2026-02-30": None,
        "Thu, 21 Foo 2025 08:16:41 GMT": None,
    }
    assert each(spark, list(cases), D.japan_day) == list(cases.values())
    assert each(spark, [None], D.japan_day) == [None]


def test_japan_day_of_numbers(spark):
    cases = {
        1789916400: DAY(2026, 9, 21),
        1789916399: DAY(2026, 9, 20),
        1789916400000: DAY(2026, 9, 21),
        0: None,
        -5: None,
    }
    assert each(spark, list(cases), D.epoch_day, "bigint") == list(cases.values())


def test_positive_int(spark):
    cases = {"12": 12, " 12 ": 12, "　7": 7, "0": None, "-3": None, "1.5": None, "x": None, "": None, "99999999999999999999": None}
    assert each(spark, list(cases), T.positive_int) == list(cases.values())


def test_label_number(spark):
    cases = {"第15話": 15, "#23": 23, "session0": 0, "第１２話": 12, "後編": None, "": None}
    assert each(spark, list(cases), T.label_number) == list(cases.values())


@pytest.mark.parametrize(
    ("href", "want"),
    [
        # RFC 3986 section 5.4, against http://a/b/c/d;p?q
        ("g", "http://a/b/c/g"),
        ("./g", "http://a/b/c/g"),
        ("g/", "http://a/b/c/g/"),
        ("/g", "http://a/g"),
        ("//g", "http://g"),
        ("?y", "http://a/b/c/d;p?y"),
        ("g?y", "http://a/b/c/g?y"),
        ("#s", "http://a/b/c/d;p?q#s"),
        ("g#s", "http://a/b/c/g#s"),
        ("g?y#s", "http://a/b/c/g?y#s"),
        (";x", "http://a/b/c/;x"),
        ("", "http://a/b/c/d;p?q"),
        (".", "http://a/b/c/"),
        ("./", "http://a/b/c/"),
        ("..", "http://a/b/"),
        ("../", "http://a/b/"),
        ("../g", "http://a/b/g"),
        ("../..", "http://a/"),
        ("../../g", "http://a/g"),
        ("../../../g", "http://a/g"),
        ("/./g", "http://a/g"),
        ("/../g", "http://a/g"),
        ("g.", "http://a/b/c/g."),
        ("..g", "http://a/b/c/..g"),
        ("./../g", "http://a/b/g"),
        ("g/../h", "http://a/b/c/h"),
        ("g?y/../x", "http://a/b/c/g?y/../x"),
        ("http://x/y", "http://x/y"),
        ("mailto:me@a", "mailto:me@a"),
        (" g ", "http://a/b/c/g"),
    ],
)
def test_resolve(spark, href, want):
    assert one(spark, U.resolve(F.lit("http://a/b/c/d;p?q"), F.lit(href))) == want


def test_resolve_against_bare_host(spark):
    assert one(spark, U.resolve(F.lit("https://h.example.com"), F.lit("a"))) == "https://h.example.com/a"


def test_url_parts(spark):
    url = F.lit("HTTPS://User@Example.COM:8080/a b/c?x=1&y=2&x=3#f")
    assert one(spark, U.scheme(url)) == "https"
    assert one(spark, U.host(url)) == "example.com"
    assert one(spark, U.origin(url)) == "https://User@Example.COM:8080"
    assert one(spark, U.path(url)) == "/a b/c"
    assert one(spark, U.query_value(url, "x")) == "1"
    assert one(spark, U.query_value(url, "z")) is None


def test_canonical(spark):
    cases = {
        "http://a.example.com/e/1.html?x=1#top": "https://a.example.com/e/1",
        "https://a.example.com/e/1/": "https://a.example.com/e/1",
        "https://a.example.com/e/1.json": "https://a.example.com/e/1",
    }
    assert each(spark, list(cases), U.canonical) == list(cases.values())


def test_images(spark):
    assert one(spark, U.unscaled(F.lit("https://a/x-scaled.jpg"))) == "https://a/x.jpg"
    assert one(spark, U.unscaled(F.lit("https://a/x.jpg"))) is None
    assert one(spark, U.without_size_prefix(F.lit("https://a/b/mode3_w640-x.jpg"))) == "https://a/b/x.jpg"
    assert one(spark, U.without_size_prefix(F.lit("https://a/mode3_w640-b/x.jpg"))) == "https://a/mode3_w640-b/x.jpg"
    cdn = "https://c/mwimgs/a/1/1280wm/img_ff.jpg?x=1"
    assert one(spark, U.full_rendition(F.lit(cdn))) == "https://c/mwimgs/a/1/-/img_ff.jpg"
    assert one(spark, U.full_rendition(F.lit("https://c/x.jpg?y"))) == "https://c/x.jpg?y"


def test_content_ids(spark):
    assert one(spark, U.content_id(F.lit(123), F.lit(7))) == "100000001230007"
    assert one(spark, U.content_title(F.lit("100000001230007"))) == 123
    assert one(spark, U.content_volume(F.lit("100000001230007"))) == 7
    assert one(spark, U.content_title(F.lit("12"))) is None
    assert one(spark, U.work_of_product(F.lit("12345678"))) == "12340001"


def test_percent_normal(spark):
    same = ["%E3%81%82 b", "あ%20b", "あ b", "%e3%81%82%20b"]
    assert set(each(spark, same, U.percent_normal)) == {"%E3%81%82%20b"}
    assert each(spark, ["a+b", "a*b~", "%zz"], U.percent_normal) == ["a%2Bb", "a%2Ab~", "%25zz"]


def test_title_splits(spark):
    def titles(column):
        return tuple(one(spark, column))

    lit = F.lit
    assert titles(T.split_middle_dot(lit("作品・第1話・前 | site"), lit("s"), lit("id"))) == ("作品", "第1話・前")
    assert titles(T.split_middle_dot(lit("第1話 | site"), lit("#作品"), lit("id"))) == ("作品", "第1話")
    assert titles(T.split_middle_dot(lit(""), lit(""), lit("id"))) == ("id", "id")
    assert titles(T.split_dash(lit("作 - 話 - x | site"))) == ("作", "話 - x")
    assert titles(T.split_dash(lit("作 | a | site"))) == ("作 | a", "")
    assert titles(T.split_brackets(lit("前 『作品』 第1話"), lit("f"))) == ("作品", "前 第1話")
    assert titles(T.split_brackets(lit("『作品』"), lit("f"))) == ("作品", "『作品』")
    assert titles(T.split_brackets(lit(" 第1話 "), lit("f"))) == ("f", "第1話")
    assert titles(T.split_known_work(lit("作　品　第1話"), lit("作　品"))) == ("作　品", "第1話")
    assert titles(T.split_known_work(lit("作　品　第1話"), lit(""))) == ("作", "品　第1話")
    assert titles(T.split_known_work(lit("作品"), lit(""))) == ("作品", "")
    assert titles(T.split_by_hint(lit("a - b - c"), lit("c a - bを読みました"))) == ("c", "a - b")
    assert titles(T.split_by_hint(lit("a - b - c"), lit(""))) == ("b - c", "a")
    assert titles(T.split_by_hint(lit("abc"), lit(""))) == ("abc", "abc")
    assert one(spark, T.bar_part(lit("話｜作｜site"), 0)) == "話"
    assert one(spark, T.bar_part(lit("話｜作｜site"), 1)) == "作"
    assert one(spark, T.bar_part(lit("話｜作｜site"), 2)) == ""


def test_credits_and_names(spark):
    assert one(spark, T.credits(F.lit("原作／甲、作画／乙、原作／甲、x"), "、", "／")) == ["甲 (原作)", "乙 (作画)"]
    assert one(spark, T.credit(F.lit("甲"), F.lit(""))) == "甲"
    assert one(spark, T.credit(F.lit(" "), F.lit("x"))) is None
    assert one(spark, T.publisher_sign(F.lit("配信元： 社"))) == "社"
    assert one(spark, T.publisher_sign(F.lit(" 社 "))) == "社"
    assert one(spark, T.path_segment(F.lit("a/b"))) == "a／b"
    assert one(spark, T.path_segment(F.lit('a:b?*"<>|'))) == "ab"
    assert one(spark, T.path_segment(F.lit(""))) == "_"
    assert one(spark, T.volume_title(F.lit(""), F.lit(3))) == "第3話"
    assert one(spark, T.caption_title(F.lit("第1話を読む"))) == "第1話"
    assert one(spark, T.caption_title(F.lit("最新話はこちら"))) == ""
    assert one(spark, T.date_beside_number(F.lit("第3話 │ 2026.1.2"))) == "2026.1.2"
    assert one(spark, T.code_label(F.lit(2), ("a", "b"))) == "2"


def test_number_from_neighbours(spark):
    def told(before, after):
        return one(spark, listing.number_from_neighbours(F.lit(before).cast("int"), F.lit(after).cast("int")))

    assert [told(3, 5), told(None, 1), told(3, 1), told(3, None), told(None, None), told(0, 0)] == [4, None, None, 4, None, None]


def test_name_order(spark):
    names = ["jk01", "13", "12.5", "01", "specials", "13b", "01"]
    rows = spark.createDataFrame([("s", n, i) for i, n in enumerate(names)], "series string, name string, pos int")
    placed = listing.by_name(rows, ["series"], "name", "pos").orderBy("place").collect()
    assert [r["name"] for r in placed] == ["01", "12.5", "13", "13b", "jk01", "specials"]


def test_locks(spark):
    def sold(price, bought, figures, images):
        flag = F.lit(bought).cast("boolean")
        left = (F.lit(figures).cast("int"), F.lit(images).cast("int"))
        return one(spark, status.not_for_sale(F.lit(price).cast("int"), flag, *left))

    assert sold(0, False, 0, 0)
    assert not sold(100, False, 0, 0)
    assert sold(100, True, 0, 0)
    assert not sold(100, True, 3, 0)
    assert not sold(0, None, 0, 2)
    assert sold(None, None, None, None)
    assert one(spark, status.open_or_bought(F.lit(None).cast("boolean"), F.lit(True)))
    assert not one(spark, status.open_or_bought(F.lit(None).cast("boolean"), F.lit(None).cast("boolean")))


def test_status(spark):
    table = {
        (True, True, False): "exists",
        (True, False, False): "saved",
        (False, True, False): "locked",
        (False, False, False): "locked",
        (False, True, True): "saved",
    }
    for flags, want in table.items():
        assert one(spark, status.result_status(*[F.lit(f) for f in flags])) == want


def test_comic(spark):
    def comic(images, prose, category, tags):
        return one(spark, links.is_comic(F.lit(images), F.lit(prose), F.lit(category), F.array(*map(F.lit, tags)), ("漫画",)))

    assert not comic(0, 0, "comic", [])
    assert comic(1, 999, "comic", [])
    assert comic(2, 60, "kiji", ["漫画家"])
    assert not comic(2, 61, "kiji", ["漫画家"])
    assert not comic(2, 0, "kiji", ["旅"])


def test_own_pages(spark):
    html = "<p>before</p><p><img src=a></p><p>12345</p><p><img src=b></p><p>after</p>"
    blocks = links.body_blocks(F.lit(html), lambda p: F.contains(p, F.lit("<img")))
    assert tuple(one(spark, links.own_pages(blocks))) == (2, 5)
    none = links.body_blocks(F.lit("<p>text</p>"), lambda p: F.contains(p, F.lit("<img")))
    assert tuple(one(spark, links.own_pages(none))) == (0, 0)
