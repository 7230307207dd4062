"""Queries on URL routing and projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriatim.functions import urls as U
from seriatim.operators import links, routing
from seriatim.plans import views
from seriatim.plans.registry import Registry
from seriatim.plans.views import sql
from seriatim.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.query

_MATCH = r"""
WITH part AS (
  SELECT page_id, url, lower(regexp_extract(url, '^([a-z]+)://', 1)) AS scheme,
         lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host,
         regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
         '&' || regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) || '&' AS query FROM pages),
hit AS (
  SELECT p.page_id, p.url, p.scheme, r.priority, r.form, r.rule, r.kind FROM part p JOIN site_rule r ON r.host = p.host
  WHERE list_contains(string_split(r.schemes, ','), p.scheme) AND regexp_matches(p.path, r.path_regex)
    AND (r.query_key = '' OR contains(p.query, '&' || r.query_key || '='))),
best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY priority, form) = 1)
"""


def _urls(spark, folder):
    return views.pages(spark, folder, "page_id", "url")


@query(
    "u1_suitable",
    sql(
        "site_rule",
        body=r"""
SELECT page_id, url, EXISTS (SELECT 1 FROM site_rule r
    WHERE r.host = lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))
      AND list_contains(string_split(r.schemes, ','), regexp_extract(url, '^([a-z]+)://', 1))) AS suitable
FROM pages""",
    ),
)
def u1(spark, folder):
    return routing.suitable(_urls(spark, folder), views.site_rule(spark, folder))


@query("u2_matching_forms", sql("site_rule", body=_MATCH + "SELECT page_id, priority, form, rule, kind FROM hit"))
def u2(spark, folder):
    return routing.matching_forms(_urls(spark, folder), views.site_rule(spark, folder)).drop("url")


@query(
    "u3_route",
    sql("site_rule", body=_MATCH + "SELECT p.page_id, p.url, b.rule, b.kind FROM pages p LEFT JOIN best b USING (page_id)"),
)
def u3(spark, folder):
    return routing.route(_urls(spark, folder), views.site_rule(spark, folder))


@query(
    "u3_unrouted",
    sql("site_rule", body=_MATCH + "SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT page_id FROM hit)"),
)
def u3_unrouted(spark, folder):
    return routing.unrouted(_urls(spark, folder), views.site_rule(spark, folder))


@query(
    "u4_forced_rule",
    sql(
        "site_rule",
        body=_MATCH
        + """, wish AS (SELECT page_id, regexp_extract(url, 'example[.]([a-z]+)', 1) AS forced FROM pages),
own AS (SELECT h.* FROM hit h JOIN wish w ON w.page_id = h.page_id AND w.forced = h.rule
        QUALIFY row_number() OVER (PARTITION BY h.page_id ORDER BY h.form) = 1)
SELECT w.page_id, w.forced, o.rule, o.kind, w.forced IN (SELECT rule FROM site_rule) AS known
FROM wish w LEFT JOIN own o USING (page_id)""",
    ),
)
def u4(spark, folder):
    forced = F.regexp_extract("url", "example[.]([a-z]+)", 1)
    named = _urls(spark, folder).withColumn("forced", forced)
    return routing.route_forced(named, views.site_rule(spark, folder), "forced").drop("url")


@query(
    "u5_publisher",
    sql(
        "site_rule",
        body="""
WITH named AS (SELECT host, min(host_publisher) AS own, arg_min(publisher, priority * 100 + form) AS house
  FROM site_rule GROUP BY host)
SELECT page_id, coalesce(n.own, n.house, '') AS publisher
FROM pages p LEFT JOIN named n ON n.host = lower(regexp_extract(p.url, '^[a-z]+://([^/?#]*)', 1))""",
    ),
)
def u5(spark, folder):
    return routing.publisher_of(_urls(spark, folder), views.site_rule(spark, folder)).drop("url")


@query(
    "u6_series_or_episode",
    sql("site_rule", body=_MATCH + "SELECT page_id, rule, kind = 'series' AS is_series FROM best WHERE kind <> 'tag'"),
)
def u6(spark, folder):
    routed = routing.route(_urls(spark, folder), views.site_rule(spark, folder))
    named = routed.where(F.col("kind").isin("series", "episode"))
    return named.select("page_id", "rule", (F.col("kind") == "series").alias("is_series"))


@query(
    "u7_ids",
    r"""
SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/[0-9]+', 1) AS lang,
       CAST(regexp_extract(url, '^[a-z]+://[^/]*/[a-z]+/([0-9]+)', 1) AS BIGINT) AS number,
       CAST(coalesce(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''), '1') AS INT) AS page_no,
       nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref
FROM pages""",
)
def u7(spark, folder):
    url, shape = F.col("url"), r"^/([a-z]+)/([0-9]+)"
    return _urls(spark, folder).select(
        "page_id",
        U.path_group(url, shape, 1).alias("lang"),
        U.path_group(url, shape, 2).cast("bigint").alias("number"),
        F.coalesce(U.query_value(url, "page"), F.lit("1")).cast("int").alias("page_no"),
        U.query_value(url, "ref").alias("ref"),
    )


@query(
    "u8_canonical",
    r"""
SELECT page_id, 'https://' || regexp_extract(url, '^https?://([^/]*/[a-z]+/[0-9]+)', 1) AS canonical,
       count(*) OVER (PARTITION BY regexp_extract(url, '^https?://([^/]*/[a-z]+/[0-9]+)', 1)) AS spellings
FROM pages""",
)
def u8(spark, folder):
    named = _urls(spark, folder).select("page_id", U.canonical(F.col("url")).alias("canonical"))
    spellings = named.groupBy("canonical").agg(F.count(F.lit(1)).alias("spellings"))
    return named.join(spellings, "canonical").select("page_id", "canonical", "spellings")


@query("u9_origin", "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS origin FROM pages")
def u9(spark, folder):
    return _urls(spark, folder).select("page_id", U.origin(F.col("url")).alias("origin"))


@query(
    "u10_numbered_pages",
    r"""
WITH num AS (
  SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/]*/[a-z]+/', 0) AS stem,
         lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host,
         CAST(regexp_extract(url, '^[a-z]+://[^/]*/[a-z]+/([0-9]+)', 1) AS BIGINT) AS n FROM pages),
top AS (SELECT host, max(n) AS last FROM num GROUP BY host),
span AS (
  SELECT num.*, url LIKE '%?%' AS is_open, url NOT LIKE '%.html' AS ranged,
         CASE WHEN url LIKE '%?%' THEN last WHEN url LIKE '%#%' THEN n - 1 ELSE n + 3 END AS stop
  FROM num JOIN top USING (host))
SELECT page_id, stem || CASE WHEN n < 100 THEN lpad(CAST(v AS VARCHAR), CAST(greatest(4, length(CAST(v AS VARCHAR))) AS INT), '0')
                             ELSE CAST(v AS VARCHAR) END AS page_url, is_open, true AS ranged
FROM (SELECT *, unnest(CASE WHEN stop >= n THEN range(n, stop + 1) ELSE [] END) AS v FROM span WHERE ranged)
UNION ALL
SELECT page_id, url, false, false FROM span WHERE NOT ranged""",
)
def u10(spark, folder):
    """Numbered-page URLs expanded; an open range ends at the last page landed for its host."""
    url = F.col("url")
    number = U.path_group(url, r"^/[a-z]+/([0-9]+)").cast("bigint")
    parts = _urls(spark, folder).select("page_id", "url", U.host(url).alias("host"), number.alias("n"))
    last = parts.groupBy("host").agg(F.max("n").alias("last"))
    start = F.when(F.col("n") < 100, F.lpad(F.col("n").cast("string"), 4, "0")).otherwise(F.col("n").cast("string"))
    stop = (
        F.when(url.like("%?%"), F.lit(""))
        .when(url.like("%#%"), (F.col("n") - 1).cast("string"))
        .otherwise((F.col("n") + 3).cast("string"))
    )
    stem = F.regexp_extract(url, r"^[a-z]+://[^/]*/[a-z]+/", 0)
    template = F.when(url.like("%.html"), url).otherwise(
        F.concat(stem, F.lit("["), start, F.lit("-"), stop, F.lit("]"))
    )
    listed = parts.withColumn("template", template).join(last, "host").select("page_id", "template", "last")
    return links.expand_pages(listed, "template", "last").select(
        "page_id", "page_url", F.col("open_ended").alias("is_open"), "ranged"
    )


@query(
    "u11_original_image",
    """
SELECT p_partkey AS part_id,
  CASE WHEN p_type = 'PROMO' THEN 'https://img.example.com/up/' || p_partkey || '.jpg' END AS unscaled,
  'https://img.example.com/m/' || p_partkey || '.jpg' AS unprefixed,
  'https://img.example.com/mwimgs/a/1/' || CASE WHEN p_type = 'ECONOMY' THEN '640wm/' || p_partkey
       ELSE '-/img_' || p_partkey END || '.jpg' || CASE WHEN p_type = 'ECONOMY' THEN '?v=1' ELSE '' END AS full_size
FROM part""",
)
def u11(spark, folder):
    part = table(spark, folder, "part", "p_partkey", "p_type")
    key, kind = F.col("p_partkey").cast("string"), F.col("p_type")
    base = F.lit("https://img.example.com")
    scaled = F.concat(base, F.lit("/up/"), key, F.when(kind == "PROMO", F.lit("-scaled.jpg")).otherwise(F.lit(".jpg")))
    sized = F.concat(
        base, F.lit("/m/"), F.when(kind.isin("SMALL", "LARGE"), F.lit("mode3_w640-")).otherwise(F.lit("")), key,
        F.lit(".jpg"),
    )
    cdn = F.concat(
        base, F.lit("/mwimgs/a/1/640wm/"), F.when(kind == "ECONOMY", F.lit("")).otherwise(F.lit("img_")), key,
        F.lit(".jpg?v=1"),
    )
    return part.select(
        F.col("p_partkey").alias("part_id"),
        U.unscaled(scaled).alias("unscaled"),
        U.without_size_prefix(sized).alias("unprefixed"),
        U.full_rendition(cdn).alias("full_size"),
    )


@query(
    "u12_content_id",
    """
WITH code AS (SELECT DISTINCT l_orderkey, l_linenumber,
    '1' || lpad(CAST(l_orderkey AS VARCHAR), 10, '0') || lpad(CAST(l_linenumber AS VARCHAR), 4, '0') AS content_id FROM lineitem)
SELECT content_id, l_orderkey AS title_id, l_linenumber AS volume, o_custkey AS series_id,
       substr(content_id, 1, 4) || '0001' AS work_id
FROM code JOIN orders ON o_orderkey = l_orderkey""",
)
def u12(spark, folder):
    """Content ids encoded, then decoded again and joined on the decoded title."""
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber").distinct()
    codes = lines.select(U.content_id(F.col("l_orderkey"), F.col("l_linenumber")).alias("content_id"))
    code = F.col("content_id")
    decoded = codes.select(
        "content_id",
        U.content_title(code).alias("title_id"),
        U.content_volume(code).alias("volume"),
        U.work_of_product(code).alias("work_id"),
    )
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey")
    return decoded.join(orders, decoded["title_id"] == orders["o_orderkey"]).select(
        "content_id", "title_id", "volume", F.col("o_custkey").alias("series_id"), "work_id"
    )


@query(
    "u13_percent_normal",
    sql(
        "anchor",
        body=r"""
SELECT url_encode(substr(href, 2)) AS title, count(*) AS links, count(DISTINCT page_id) AS pages
FROM anchor GROUP BY 1""",
    ),
)
def u13(spark, folder):
    """Link titles in their one percent-encoded spelling, whichever way a page spells them."""
    pages = views.pages(spark, folder)
    raw = F.substr(F.col("href"), F.lit(2))
    # Pages under https write the segment encoded, the others as text: both must meet.
    spelt = F.when(F.startswith("url", F.lit("https:")), U.percent_encode(raw)).otherwise(raw)
    return (
        pages.select("page_id", "url", F.explode(links.hrefs(F.col("html"))).alias("href"))
        .select("page_id", U.percent_normal(spelt).alias("title"))
        .groupBy("title", "page_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("title")
        .agg(F.sum("n").cast("bigint").alias("links"), F.count(F.lit(1)).alias("pages"))
    )
