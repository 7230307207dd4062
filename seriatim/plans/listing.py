"""Queries on listing order, places and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriatim.functions import dates as D
from seriatim.functions import text as T
from seriatim.functions import urls as U
from seriatim.operators import links, listing, ordered
from seriatim.plans import views
from seriatim.plans.registry import Registry
from seriatim.plans.views import sql
from seriatim.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.query

_SERIES = ["series_id"]


@query(
    "w1_ordinal",
    sql(
        "listing",
        body="""
SELECT l.series_id, l.episode_id, o.number FROM listing l LEFT JOIN
  (SELECT episode_id, row_number() OVER (PARTITION BY series_id ORDER BY pos) AS number FROM listing WHERE open) o USING (episode_id)""",
    ),
)
def w1(spark, folder):
    """Every episode's place among the open ones; null for an episode that is not listed."""
    listed = views.listing(spark, folder).select("series_id", "pos", "episode_id", "open")
    placed = ordered.number_rows(listed.where("open"), _SERIES, "pos", "number").select("episode_id", "number")
    return listed.join(placed, "episode_id", "left").select("series_id", "episode_id", "number")


@query(
    "w2_neighbours",
    sql(
        "listing",
        body="""
SELECT series_id, episode_id, lag(episode_id) OVER w AS before, lead(episode_id) OVER w AS after
FROM listing WINDOW w AS (PARTITION BY series_id ORDER BY pos)""",
    ),
)
def w2(spark, folder):
    listed = views.listing(spark, folder).select("series_id", "pos", "episode_id")
    return ordered.neighbours(listed, _SERIES, "pos", "episode_id", "before", "after").drop("pos")


_PRINTED = """
WITH printed AS (SELECT l_suppkey AS series_id, l_partkey AS item, l_orderkey * 10 + l_linenumber AS pos FROM lineitem)
"""


def _printed(spark, folder):
    """A supplier's line items as a listing that prints items many times."""
    lines = table(spark, folder, "lineitem", "l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    return lines.select(
        F.col("l_suppkey").alias("series_id"),
        F.col("l_partkey").alias("item"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )


@query(
    "w3_first_occurrence",
    _PRINTED
    + """SELECT series_id, item, pos, row_number() OVER (PARTITION BY series_id ORDER BY pos, item) AS place
FROM (SELECT series_id, item, min(pos) AS pos FROM printed GROUP BY ALL)""",
)
def w3(spark, folder):
    once = ordered.first_of_each(_printed(spark, folder), ["series_id", "item"], "pos")
    return ordered.number_rows(once, _SERIES, "pos", "place", ties=["item"])


@query(
    "w4_dedup_then_reverse",
    _PRINTED
    + """SELECT series_id, item, pos, row_number() OVER (PARTITION BY series_id ORDER BY pos DESC, item DESC) AS place
FROM (SELECT series_id, item, min(pos) AS pos FROM printed GROUP BY ALL)""",
)
def w4_dedup_first(spark, folder):
    return listing.newest_first(_printed(spark, folder), _SERIES, "item", "pos")


@query(
    "w4_reverse_then_dedup",
    _PRINTED
    + """SELECT series_id, item, pos, row_number() OVER (PARTITION BY series_id ORDER BY pos DESC, item DESC) AS place
FROM (SELECT series_id, item, max(pos) AS pos FROM printed GROUP BY ALL)""",
)
def w4_reverse_first(spark, folder):
    return listing.newest_first(_printed(spark, folder), _SERIES, "item", "pos", reverse_then_dedup=True)


@query(
    "w4_conditional_reverse",
    _PRINTED
    + """SELECT p.series_id, p.item, p.pos, row_number() OVER (PARTITION BY p.series_id ORDER BY
    CASE WHEN s.s_acctbal > 4000 THEN -p.pos ELSE p.pos END, p.item) AS place
FROM (SELECT series_id, item, min(pos) AS pos FROM printed GROUP BY ALL) p JOIN supplier s ON s.s_suppkey = p.series_id""",
)
def w4_conditional(spark, folder):
    """Reversed only for the series whose supplier's balance says it prints newest first."""
    supplier = table(spark, folder, "supplier", "s_suppkey", "s_acctbal")
    flag = supplier.select(F.col("s_suppkey").alias("series_id"), (F.col("s_acctbal") > 4000).alias("newest_first"))
    return listing.directed(_printed(spark, folder), flag, _SERIES, "item", "pos", "newest_first")


@query(
    "w5_site_order_key",
    sql(
        "listing",
        body="""
SELECT series_id, episode_id, row_number() OVER (PARTITION BY series_id
    ORDER BY CASE WHEN priority LIKE '1-%' THEN 0 ELSE month(listed) END, pos DESC) AS place FROM listing""",
    ),
)
def w5(spark, folder):
    key = F.when(~F.col("priority").like("1-%"), F.month("listed"))
    listed = views.listing(spark, folder).select("series_id", "pos", "episode_id", key.alias("order_no"))
    return listing.by_site_key(listed, _SERIES, "order_no", "pos").select("series_id", "episode_id", "place")


@query(
    "w6_conditional_order",
    sql(
        "listing",
        body="""
WITH num AS (SELECT series_id, episode_id, pos, TRY_CAST(nullif(regexp_extract(label, '[0-9]+', 0), '') AS BIGINT) AS n FROM listing),
stat AS (SELECT series_id, count(*) = count(n) AND count(DISTINCT n) = count(*) AS numbered FROM num GROUP BY series_id)
SELECT series_id, episode_id, row_number() OVER (PARTITION BY series_id ORDER BY CASE WHEN numbered THEN n ELSE -pos END) AS place
FROM num JOIN stat USING (series_id)""",
    ),
)
def w6(spark, folder):
    listed = views.listing(spark, folder).select("series_id", "pos", "episode_id", "label")
    ordered_by = listing.by_label_number(listed, _SERIES, "episode_id", "label", "pos")
    return ordered_by.select("series_id", "episode_id", "place")


@query(
    "w7_name_order",
    r"""
WITH named AS (SELECT p_brand AS brand, CASE p_type WHEN 'SMALL' THEN CAST(p_size AS VARCHAR) WHEN 'LARGE' THEN p_size || '.5'
    WHEN 'PROMO' THEN 'jk' || p_size WHEN 'ECONOMY' THEN p_name ELSE p_size || 'b' END AS name FROM part),
once AS (SELECT DISTINCT brand, name, regexp_extract(name, '^([^0-9]*)([0-9]+(?:\.[0-9]+)?)(.*)$', 2) AS num FROM named)
SELECT brand, name, row_number() OVER (PARTITION BY brand ORDER BY
    CASE WHEN num = '' THEN name ELSE regexp_extract(name, '^[^0-9]*', 0) END,
    CASE WHEN num = '' THEN 'inf'::DOUBLE ELSE CAST(num AS DOUBLE) END,
    CASE WHEN num = '' THEN '' ELSE regexp_extract(name, '^[^0-9]*[0-9]+(?:\.[0-9]+)?(.*)$', 1) END, name) AS place
FROM once""",
)
def w7(spark, folder):
    part = table(spark, folder, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    kind, size = F.col("p_type"), F.col("p_size").cast("string")
    name = (
        F.when(kind == "SMALL", size)
        .when(kind == "LARGE", F.concat(size, F.lit(".5")))
        .when(kind == "PROMO", F.concat(F.lit("jk"), size))
        .when(kind == "ECONOMY", F.col("p_name"))
        .otherwise(F.concat(size, F.lit("b")))
    )
    named = part.select(F.col("p_brand").alias("brand"), name.alias("name"), F.col("p_partkey").alias("pos"))
    return listing.by_name(named, ["brand"], "name", "pos").select("brand", "name", "place")


@query(
    "w8_first_per_number",
    """
SELECT series_id, number, l_partkey, row_number() OVER (PARTITION BY series_id ORDER BY number) AS place FROM (
  SELECT l_orderkey AS series_id, l_linenumber AS number, min(l_partkey) AS l_partkey FROM lineitem
  WHERE l_linestatus = 'O' GROUP BY ALL)""",
)
def w8(spark, folder):
    """One line per line number of an order, by part; lines without a number are dropped."""
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_linestatus")
    printed = lines.select(
        F.col("l_orderkey").alias("series_id"),
        F.when(F.col("l_linestatus") == "O", F.col("l_linenumber")).alias("number"),
        "l_partkey",
    )
    return listing.by_number(printed, _SERIES, "number", "l_partkey", [])


@query(
    "w9_pages_in_order",
    """
SELECT l_orderkey AS episode_id, l_partkey * 100000 + l_suppkey AS image, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY CASE WHEN l_linenumber = 7 THEN 0 ELSE l_linenumber END, l_partkey * 100000 + l_suppkey) AS place
FROM lineitem WHERE l_returnflag <> 'R'""",
)
def w9(spark, folder):
    """Pages that have an image, by page index; a missing index counts as 0."""
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    shown = lines.where("l_returnflag <> 'R'").select(
        F.col("l_orderkey").alias("episode_id"),
        F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")).alias("page_no"),
        (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("image"),
    )
    placed = listing.by_site_key(shown, ["episode_id"], "page_no", "image", last_printed_first=False)
    return placed.select("episode_id", "image", "place")


@query(
    "w10_open_neighbours",
    sql(
        "listing",
        "series",
        body="""
WITH near AS (SELECT series_id, episode_id,
  last_value(CASE WHEN open THEN episode_id END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ob,
  first_value(CASE WHEN open THEN episode_id END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS oa,
  lag(episode_id) OVER (PARTITION BY series_id ORDER BY pos) AS pb, lead(episode_id) OVER (PARTITION BY series_id ORDER BY pos) AS pa FROM listing)
SELECT series_id, episode_id, CASE WHEN writer = 'HOUSEHOLD' THEN pb ELSE ob END AS before, CASE WHEN writer = 'HOUSEHOLD' THEN pa ELSE oa END AS after
FROM near JOIN series USING (series_id)""",
    ),
)
def w10(spark, folder):
    """The nearest open episodes; one writer's series tell no flags, so theirs are the printed ones."""
    listed = views.listing(spark, folder).select("series_id", "pos", "episode_id", "open")
    writers = views.series(spark, folder).select("series_id", "writer")
    flagged = listed.join(writers, "series_id").withColumn("open", F.when(F.col("writer") != "HOUSEHOLD", F.col("open")))
    near = listing.open_neighbours(flagged, _SERIES, "pos", "episode_id", "open", "before", "after")
    return near.select("series_id", "episode_id", "before", "after")


@query(
    "w11_around_number",
    sql(
        "listing",
        body="""
WITH num AS (SELECT series_id, episode_id, open, year(listed) * 10000 + month(listed) * 100 + day(listed) AS n FROM listing)
SELECT p.series_id, p.episode_id, p.n AS number, max(l.n) FILTER (WHERE l.n < p.n) AS before, min(l.n) FILTER (WHERE l.n > p.n) AS after
FROM num p LEFT JOIN num l ON l.series_id = p.series_id AND l.open WHERE NOT p.open GROUP BY ALL""",
    ),
)
def w11(spark, folder):
    """For each closed episode's day, the listed days just before and after it."""
    day = F.year("listed").cast("bigint") * 10000 + F.month("listed") * 100 + F.dayofmonth("listed")
    listed = views.listing(spark, folder).select("series_id", "episode_id", "open", day.alias("number"))
    shown = listed.where("open").select("series_id", "number", F.col("number").alias("item"))
    asked = listed.where("NOT open").select("series_id", "number", "episode_id")
    return listing.around_number(shown, asked, _SERIES, "number", "item", "episode_id")


@query(
    "w12_islands",
    sql(
        body="""
WITH row AS (SELECT o_custkey AS series_id, o_orderkey AS pos, CASE WHEN o_orderpriority NOT LIKE '1-%' THEN o_orderstatus END AS key FROM orders),
cut AS (SELECT *, CASE WHEN key IS NOT NULL AND key IS NOT DISTINCT FROM lag(key) OVER (PARTITION BY series_id ORDER BY pos) THEN 0 ELSE 1 END AS brk FROM row),
isle AS (SELECT *, sum(brk) OVER (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM cut)
SELECT series_id, CAST(island AS BIGINT) AS island, key, count(*) AS strips, min(pos) AS first_pos FROM isle GROUP BY series_id, island, key""",
    ),
)
def w12(spark, folder):
    """Consecutive strips with one page key make one page; a strip without a key stands alone."""
    orders = table(spark, folder, "orders", "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    strips = orders.select(
        F.col("o_custkey").alias("series_id"),
        F.col("o_orderkey").alias("pos"),
        F.when(~F.col("o_orderpriority").like("1-%"), F.col("o_orderstatus")).alias("key"),
    )
    cut = ordered.islands(strips, _SERIES, "pos", "key", "island")
    return cut.groupBy("series_id", "island", "key").agg(
        F.count(F.lit(1)).alias("strips"), F.min("pos").alias("first_pos")
    )


@query(
    "w13_number_from_neighbours",
    sql(
        "listing",
        body="""
WITH num AS (SELECT series_id, episode_id, coalesce(TRY_CAST(nullif(regexp_extract(label, '[0-9]+', 0), '') AS BIGINT), 0) AS n, pos FROM listing),
near AS (SELECT series_id, episode_id, lag(n) OVER w AS b, lead(n) OVER w AS a FROM num WINDOW w AS (PARTITION BY series_id ORDER BY pos))
SELECT series_id, episode_id, CASE WHEN a > 0 THEN nullif(a - 1, 0) WHEN b > 0 THEN b + 1 END AS number FROM near""",
    ),
)
def w13(spark, folder):
    number = F.coalesce(T.label_number(F.col("label")), F.lit(0))
    listed = views.listing(spark, folder).select("series_id", "pos", "episode_id", number.alias("n"))
    near = ordered.neighbours(listed, _SERIES, "pos", "n", "before", "after")
    told = listing.number_from_neighbours(F.col("before"), F.col("after"))
    return near.select("series_id", "episode_id", told.alias("number"))


@query(
    "w14_open_positions",
    """
SELECT episode_id, position FROM (SELECT o_orderkey AS episode_id, unnest(string_split(bin(o_orderkey), '')) AS flag,
    unnest(range(1, length(bin(o_orderkey)) + 1)) AS position FROM orders) WHERE flag = '1'""",
)
def w14(spark, folder):
    """Which strips of a bit string are open: the bits of the episode's own number."""
    orders = table(spark, folder, "orders", "o_orderkey")
    flags = F.transform(F.split(F.bin("o_orderkey"), ""), lambda bit: bit == "1")
    return orders.select(
        F.col("o_orderkey").alias("episode_id"), F.explode(listing.open_positions(flags)).alias("position")
    )


@query(
    "w15_first_page_only",
    sql("page_row", body="SELECT episode_id, min(page_no) AS page_no, arg_min(image, page_no) AS image FROM page_row GROUP BY episode_id"),
)
def w15(spark, folder):
    return ordered.first_of_each(views.page_row(spark, folder), ["episode_id"], "page_no", ["image"])


@query(
    "w16_date_beside_number",
    """
SELECT o_orderkey AS episode_id, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS number, CAST(o_orderdate AS DATE) AS published FROM orders""",
)
def w16(spark, folder):
    """Number and date taken apart from one "updated" line."""
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    day = F.date_format("o_orderdate", "yyyy/M/d")
    token = F.concat(F.lit("第 "), F.col("o_custkey").cast("string"), F.lit("話"))
    line = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("│ "), day)).otherwise(
        F.concat(token, F.lit(" | "), day, F.lit("　"))
    )
    return orders.withColumn("line", line).select(
        F.col("o_orderkey").alias("episode_id"),
        T.label_number(T.number_token(F.col("line"))).alias("number"),
        D.japan_day(T.date_beside_number(F.col("line"))).alias("published"),
    )


@query(
    "w17_carried_captions",
    sql(
        "anchor",
        body="""
WITH row AS (SELECT page_id, idx, CASE WHEN NOT regexp_matches(href, '^/[A-Z]') THEN href END AS link,
    CASE WHEN regexp_matches(href, '^/[A-Z]') THEN substr(href, 2) END AS caption FROM anchor),
held AS (SELECT page_id, idx, link, coalesce(last_value(caption IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY idx
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS caption FROM row)
SELECT page_id, link, arg_min(caption, idx) AS caption FROM held WHERE link IS NOT NULL GROUP BY page_id, link""",
    ),
)
def w17(spark, folder):
    """Capitalised anchors stand in for captions; every other anchor takes the last one before it."""
    found = F.posexplode(links.anchors(F.col("html"))).alias("at", "anchor")
    pages = views.pages(spark, folder).select("page_id", found)
    is_caption = F.col("anchor.href").rlike("^/[A-Z]")
    rows = pages.select(
        "page_id",
        "at",
        F.when(~is_caption, F.col("anchor.href")).alias("link"),
        F.when(is_caption, F.col("anchor.text")).alias("caption"),
    )
    return listing.captions(rows, ["page_id"], "at", "link", "caption").select("page_id", "link", "caption")


@query(
    "w18_running_places",
    sql(
        "anchor",
        body="""
WITH once AS (SELECT regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1) AS lang, href AS item, min(page_id * 10000 + idx) AS at_
  FROM anchor GROUP BY 1, 2)
SELECT lang, item, row_number() OVER (PARTITION BY lang ORDER BY at_) AS place FROM once""",
    ),
)
def w18(spark, folder):
    items = F.posexplode(links.hrefs(F.col("html"))).alias("at", "item")
    pages = views.pages(spark, folder).select("page_id", U.path_group(F.col("url"), "^/([a-z]+)/").alias("lang"), items)
    return listing.running_places(pages, ["lang"], "page_id", "at", "item").select("lang", "item", "place")
