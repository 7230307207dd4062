"""Queries on whole visits: URLs to results, search pages to links."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriatim import visits
from seriatim.functions import urls as U
from seriatim.operators import status
from seriatim.plans import views
from seriatim.plans.registry import Registry
from seriatim.plans.views import sql
from seriatim.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.query

_VISITED = """
WITH rank AS (SELECT r.series_id, r.episode_id, r.label, r.status, row_number() OVER w AS r, count(*) OVER (PARTITION BY r.series_id) AS n,
    last_value(l.priority) OVER (PARTITION BY r.series_id ORDER BY r.pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_priority
  FROM result r JOIN listing l USING (episode_id) WINDOW w AS (PARTITION BY r.series_id ORDER BY r.pos)),
seed AS (SELECT series_id, min(episode_id) AS seed FROM listing WHERE NOT open GROUP BY series_id),
reached AS (
  SELECT s.series_id, 'series/' || s.series_id AS visit, k.episode_id, k.status FROM series s JOIN rank k USING (series_id) WHERE s.writer < 'H'
  UNION ALL
  SELECT s.series_id, 'episode/' || d.seed, k.episode_id, k.status FROM series s JOIN seed d USING (series_id)
  JOIN rank k USING (series_id) JOIN rank q ON q.episode_id = d.seed
  WHERE s.writer >= 'H' AND (k.r >= q.r OR k.last_priority LIKE '2-%'))
SELECT 'https://' || s.host || '/' || visit AS visit, s.title AS title, count(*) FILTER (WHERE status = 'saved') AS saved,
  count(*) FILTER (WHERE status = 'exists') AS "exists", count(*) FILTER (WHERE status = 'locked') AS locked, count(*) AS episodes
FROM reached JOIN series s USING (series_id) WHERE s.nation_id IN (SELECT n_nationkey FROM nation) GROUP BY ALL
"""


@query("e1_visit", sql("result", "series", body=_VISITED))
def e1(spark, folder):
    """A visit per series: its series page, or a bulk walk on from its first locked episode."""
    nation = table(spark, folder, "nation", "n_nationkey", "n_name")
    host = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".example.com"))
    forms = F.array(
        *[
            F.struct(F.lit(n).alias("form"), F.lit(kind).alias("kind"), F.lit(f"^/{kind}/[0-9]+$").alias("path_regex"))
            for n, kind in enumerate(("series", "episode"))
        ]
    )
    rules = nation.select(
        F.col("n_nationkey").alias("priority"), F.col("n_name").alias("rule"), host.alias("host"), F.inline(forms)
    ).select(
        "*",
        F.array(F.lit("https")).alias("schemes"),
        F.lit("").alias("query_key"),
        F.col("rule").alias("publisher"),
        F.lit(None).cast("string").alias("host_publisher"),
    )
    series = views.series(spark, folder).select("series_id", "title", "host", "writer")

    def url_of(kind, ident):
        return F.concat(F.lit("https://"), F.col("host"), F.lit(f"/{kind}/"), F.col(ident).cast("string"))

    locked = views.listing(spark, folder).where("NOT open").groupBy("series_id").agg(F.min("episode_id").alias("seed"))
    entries = series.join(locked, "series_id", "left")
    urls = entries.select(
        F.when(F.col("writer") < "H", url_of("series", "series_id")).otherwise(url_of("episode", "seed")).alias("url")
    ).where("url IS NOT NULL")
    hosts = series.select("series_id", "host", "title")
    listed = views.listing(spark, folder).select("series_id", "pos", "episode_id").join(hosts, "series_id")
    listings = listed.select(
        url_of("series", "series_id").alias("series_url"), "pos", url_of("episode", "episode_id").alias("episode_url")
    )
    linked = views.edge(spark, folder).join(hosts, "series_id")
    edges = linked.select(
        url_of("episode", "node").alias("url"),
        url_of("episode", "prev_node").alias("prev_url"),
        url_of("episode", "next_node").alias("next_url"),
    )
    results = views.result(spark, folder).join(hosts, "series_id")
    episodes = results.select(
        url_of("episode", "episode_id").alias("url"), "title", F.col("label").alias("episode_title"), "status"
    )
    visited = visits.visit(urls, rules, listings, edges, episodes, bulk=True)
    counts = {s: F.count_if(F.col("status") == s).alias(s) for s in status.STATUSES}
    return visited.groupBy("visit", "title").agg(*counts.values(), F.count(F.lit(1)).alias("episodes"))


_SEARCHED = r"""
WITH seen AS (SELECT page_id, url, origin, href, min(idx) AS idx FROM anchor GROUP BY ALL),
placed AS (SELECT page_id, origin || href AS link, regexp_extract(origin, '^([a-z]+):', 1) AS scheme,
    lower(regexp_extract(origin, '//(.*)$', 1)) AS host, href AS path FROM seen WHERE origin || href <> split_part(url, '#', 1)),
taken AS (SELECT p.page_id, p.link, r.rule, r.kind FROM placed p JOIN site_rule r ON r.host = p.host
  WHERE list_contains(string_split(r.schemes, ','), p.scheme) AND regexp_matches(p.path, r.path_regex) AND r.query_key = ''
  QUALIFY row_number() OVER (PARTITION BY p.page_id, p.link ORDER BY r.priority, r.form) = 1),
num AS (SELECT regexp_extract(url, '^[a-z]+://([^/]*/[a-z]+)/', 1) AS site,
    CAST(regexp_extract(url, '^[a-z]+://[^/]*/[a-z]+/([0-9]+)', 1) AS BIGINT) AS n, min(page_id) AS page_id FROM pages GROUP BY ALL),
fresh AS (SELECT site, n, link, rule, kind FROM num JOIN taken USING (page_id) QUALIFY row_number() OVER (PARTITION BY site, link ORDER BY n) = 1),
run AS (SELECT *, lead(n) OVER (PARTITION BY site ORDER BY n) AS following FROM num),
gap AS (SELECT site, min(n + 1) FILTER (WHERE following IS NULL OR following > n + 1) AS missing FROM run GROUP BY site),
dry AS (SELECT site, min(n) AS empty FROM num WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.site = num.site AND f.n = num.n) GROUP BY site)
SELECT f.site, f.n AS page_no, f.link, f.rule, f.kind FROM fresh f JOIN gap USING (site) LEFT JOIN dry USING (site)
WHERE f.site LIKE '%/en' OR f.n < least(gap.missing, coalesce(dry.empty, gap.missing))
"""


@query("e2_search", sql("site_rule", "anchor", body=_SEARCHED))
def e2(spark, folder):
    """A search per site and language: English ones over a closed range, the others open-ended."""
    url = F.col("url")
    pages = views.pages(spark, folder)
    numbered = pages.select(
        F.regexp_extract(url, "^[a-z]+://([^/]*/[a-z]+)/", 1).alias("site"),
        U.path_group(url, "^/[a-z]+/([0-9]+)").cast("bigint").alias("n"),
    )
    span = numbered.groupBy("site").agg(F.min("n").alias("first"), F.max("n").alias("last"))
    stop = F.when(F.endswith("site", F.lit("/en")), F.col("last").cast("string")).otherwise(F.lit(""))
    template = F.concat(F.lit("https://"), F.col("site"), F.lit("/["), F.col("first").cast("string"), F.lit("-"), stop, F.lit("]"))
    templates = span.select(template.alias("search"), "last")
    # a landed page of these sites is the same with any query
    named = pages.withColumn("page", U.canonical(url))
    found = visits.search(templates, named, views.site_rule(spark, folder), page="page")
    site = F.regexp_extract("search", "^https://(.*)/\\[", 1)
    return found.select(site.alias("site"), "page_no", "link", "rule", "kind")
