"""Queries on links and blocks of the page corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriatim.functions import urls as U
from seriatim.operators import chain, links
from seriatim.plans import views
from seriatim.plans.registry import Registry
from seriatim.plans.views import sql

REGISTRY = Registry()
query = REGISTRY.query

#: The words whose presence marks a tag as a genre in the tag queries.
GENRE_WORDS = ("the", "der", "la", "de")

_TAKEN = r"""
WITH seen AS (SELECT page_id, url, origin, href, min(idx) AS idx FROM anchor GROUP BY ALL),
placed AS (SELECT page_id, url, origin || href AS link, row_number() OVER (PARTITION BY page_id ORDER BY idx) AS pos,
                  regexp_extract(origin, '^([a-z]+):', 1) AS scheme, lower(regexp_extract(origin, '//(.*)$', 1)) AS host,
                  href AS path FROM seen WHERE origin || href <> split_part(url, '#', 1)),
taken AS (SELECT p.*, r.rule, r.kind FROM placed p JOIN site_rule r ON r.host = p.host
          WHERE list_contains(string_split(r.schemes, ','), p.scheme) AND regexp_matches(p.path, r.path_regex)
            AND r.query_key = ''
          QUALIFY row_number() OVER (PARTITION BY p.page_id, p.pos ORDER BY r.priority, r.form) = 1)
"""


@query(
    "l1_downloadable_links",
    sql("site_rule", "anchor", body=_TAKEN + "SELECT page_id, url, pos, link, rule, kind FROM taken"),
)
def l1(spark, folder):
    return links.downloadable_links(views.pages(spark, folder), views.site_rule(spark, folder))


_VARIANTS = r"""
  CASE WHEN href LIKE '%,' OR href LIKE '%.' THEN 'bare' WHEN regexp_matches(href, '^/[A-Z]') THEN 'up'
       WHEN regexp_matches(href, '[^ -~]') THEN 'query' WHEN length(href) > 8 THEN 'dot'
       WHEN length(href) = 3 THEN 'host' WHEN length(href) = 4 THEN 'mail' ELSE 'root' END"""


@query(
    "l2_resolved_links",
    sql(
        "anchor",
        body=f"""
WITH form AS (SELECT page_id, idx AS pos, origin, href, substr(href, 2) AS word, {_VARIANTS} AS form,
    split_part(split_part(url, '#', 1), '?', 1) AS bare,
    regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '^(.*/)[^/]*$', 1) AS folder,
    regexp_extract(origin, '^[a-z]+:', 0) AS scheme FROM anchor)
SELECT page_id, pos, CASE form WHEN 'bare' THEN folder || word
    WHEN 'up' THEN CASE WHEN regexp_matches(folder, '/[0-9]+/$') THEN regexp_extract(folder, '^(.*/)[^/]*/$', 1)
                        ELSE origin || '/' END || word
    WHEN 'query' THEN bare || '?' || word WHEN 'dot' THEN folder || word
    WHEN 'host' THEN scheme || '//' || word || '.example.com/' WHEN 'mail' THEN 'mailto:' || word
    ELSE origin || href END AS link
FROM form""",
    ),
)
def l2(spark, folder):
    """Every kind of reference, made from the landed root-relative ones, resolved against its page."""
    href = F.col("href")
    word = F.substr(href, F.lit(2))
    written = (
        F.when(href.like("%,") | href.like("%."), word)
        .when(href.rlike("^/[A-Z]"), F.concat(F.lit("../"), word))
        .when(href.rlike("[^ -~]"), F.concat(F.lit(" ?"), word))
        .when(F.length(href) > 8, F.concat(F.lit("./x/../"), word))
        .when(F.length(href) == 3, F.concat(F.lit("//"), word, F.lit(".example.com/")))
        .when(F.length(href) == 4, F.concat(F.lit("mailto:"), word))
        .otherwise(href)
    )
    pages = views.pages(spark, folder).withColumn("base", U.base_parts(F.col("url")))
    found = pages.select("page_id", "base", F.posexplode(links.hrefs(F.col("html"))).alias("at", "href"))
    return found.select(
        "page_id", (F.col("at") + 1).alias("pos"), U.resolve_from(F.col("base"), written).alias("link")
    )


@query(
    "l3_scoped_links",
    r"""
WITH nav AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS origin,
                    regexp_extract(html, '<nav>(.*?)</nav>', 1) AS nav FROM pages),
one AS (SELECT page_id, url, origin, unnest(regexp_extract_all(nav, '<a href="([^"]*)">', 1)) AS href,
               unnest(range(1, len(regexp_extract_all(nav, '<a href="([^"]*)">', 1)) + 1)) AS idx FROM nav),
seen AS (SELECT page_id, url, origin || href AS link, href, min(idx) AS idx FROM one GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY idx) AS pos FROM seen WHERE link <> split_part(url, '#', 1))
SELECT page_id, pos, link FROM placed WHERE regexp_matches(href, '^/[a-z]{2,6}$')""",
)
def l3(spark, folder):
    scoped = links.same_host_links(views.pages(spark, folder), "nav", "^/[a-z]{2,6}$")
    return scoped.select("page_id", "pos", "link")


@query(
    "l3_own_work_links",
    r"""
WITH one AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS origin, regexp_extract(url, '^[a-z]+://[^/]*/([a-z])', 1) AS own,
               unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href,
               unnest(range(1, len(regexp_extract_all(html, '<a href="([^"]*)">', 1)) + 1)) AS idx FROM pages),
seen AS (SELECT page_id, url, own, origin || href AS link, href, min(idx) AS idx FROM one GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY idx) AS pos FROM seen WHERE link <> split_part(url, '#', 1))
SELECT page_id, pos, link FROM placed WHERE regexp_extract(href, '^/([a-z])[a-z]+$', 1) = own AND own <> ''""",
)
def l3_own(spark, folder):
    """Links to the page's own work; here a work is the first letter of a path."""
    scoped = links.own_work_links(views.pages(spark, folder), None, "^/([a-z])[a-z]+$", "^/([a-z])")
    return scoped.select("page_id", "pos", "link")


@query(
    "l3_shaped_links",
    r"""
WITH one AS (SELECT page_id, regexp_extract(url, '^([a-z]+:)', 1) AS scheme, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS origin,
               unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href,
               unnest(range(1, len(regexp_extract_all(html, '<a href="([^"]*)">', 1)) + 1)) AS idx FROM pages),
spelt AS (SELECT page_id, idx, href, CASE WHEN regexp_matches(href, '^/[a-z]{3}$') THEN scheme || '//other.example.org' ELSE origin END || href AS link FROM one),
seen AS (SELECT page_id, link, min(idx) AS idx FROM spelt WHERE regexp_matches(href, '^/[a-z]{2,6}$') GROUP BY ALL)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY idx) AS pos, link FROM seen""",
)
def l3_shaped(spark, folder):
    """Links of one shape on any host; short ones are respelt to another host, with a query that is cut again."""
    respelt = F.regexp_replace("html", '<a href="/([a-z]{3})">', '<a href="//other.example.org/$1?from=$1#top">')
    pages = views.pages(spark, folder).withColumn("html", respelt)
    return links.shaped_links(pages, "^/[a-z]{2,6}$").select("page_id", "pos", "link")


_PAGED = r"""
WITH page AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1) AS lang, url LIKE '%#top' AS failed FROM pages),
seen AS (SELECT p.lang, p.page_id, a.href, min(a.idx) AS idx FROM page p JOIN anchor a USING (page_id) WHERE NOT p.failed GROUP BY ALL),
fresh AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY lang, href ORDER BY page_id) = 1),
stop AS (SELECT p.lang, min(p.page_id) FILTER (WHERE f.n IS NULL) AS stop FROM page p
         LEFT JOIN (SELECT lang, page_id, count(*) AS n FROM fresh GROUP BY ALL) f USING (lang, page_id) GROUP BY p.lang)
"""


def _paged(spark, folder):
    url = F.col("url")
    lang = U.path_group(url, "^/([a-z]+)/")
    pages = views.pages(spark, folder, "page_id", "url").select(
        "page_id", lang.alias("lang"), F.endswith(url, F.lit("#top")).alias("failed")
    )
    found = F.transform(F.array_distinct(links.hrefs(F.col("html"))), lambda h, i: F.struct(h.alias("link"), i.alias("pos")))
    anchors = views.pages(spark, folder).select("page_id", lang.alias("lang"), F.inline(found))
    return pages, anchors


@query("l4_paginate_closed", sql("anchor", body=_PAGED + "SELECT lang, page_id, href AS link FROM fresh"))
def l4_closed(spark, folder):
    """Links fresh on each page of a language; failed and empty pages stepped over."""
    pages, anchors = _paged(spark, folder)
    read = links.paginate(pages, anchors, ["lang"], "page_id", "failed", open_ended=False)
    return read.select("lang", "page_id", "link")


@query(
    "l4_paginate_open",
    sql(
        "anchor",
        body=_PAGED
        + """SELECT f.lang, f.page_id, f.href AS link FROM fresh f JOIN stop s USING (lang)
WHERE s.stop IS NULL OR f.page_id < s.stop""",
    ),
)
def l4_open(spark, folder):
    """The same, ended at a language's first page that fails or holds nothing fresh."""
    pages, anchors = _paged(spark, folder)
    read = links.paginate(pages, anchors, ["lang"], "page_id", "failed", open_ended=True)
    return read.select("lang", "page_id", "link")


@query(
    "l5_listing_end",
    sql(
        "episode",
        body="""
WITH told AS (SELECT series_id, pos, n_pages, sum(n_pages) OVER w AS upto, row_number() OVER w AS place,
    sum(n_pages) OVER (PARTITION BY series_id) - 4 AS total FROM episode
    WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
stop AS (SELECT series_id, min(place) FILTER (WHERE n_pages < 2 OR (total > 0 AND upto >= total) OR place >= 8) AS stop
         FROM told GROUP BY series_id)
SELECT t.series_id, t.pos, CAST(t.upto AS BIGINT) AS upto, t.place FROM told t JOIN stop s USING (series_id)
WHERE s.stop IS NULL OR t.place <= s.stop""",
    ),
)
def l5(spark, folder):
    """Listing pages read until one is short, the total is reached, or eight are read."""
    pages = views.episode(spark, folder).select("series_id", "pos", "n_pages")
    total = pages.groupBy("series_id").agg((F.sum("n_pages") - 4).alias("total"))
    listed = links.listing_end(
        pages.join(total, "series_id"), ["series_id"], "pos", "n_pages", page_size=2, total="total", max_pages=8
    )
    return listed.select("series_id", "pos", "upto", "place")


@query(
    "l6_follow_next_pages",
    sql(
        "edge",
        body="""
SELECT e.series_id, e.node, row_number() OVER (PARTITION BY e.series_id ORDER BY e.node) - 1 AS depth
FROM edge e""",
    ),
)
def l6(spark, folder):
    """Listing pages in the order their next-page links give, from each series' first page on."""
    edges = views.edge(spark, folder)
    first = edges.groupBy("series_id").agg(F.min("node").alias("seed"))
    walked = chain.walk(edges, first, "node", "next_node", "seed")
    return walked.select("series_id", "node", "depth")


_BLOCKS = r"""
WITH body AS (SELECT page_id, regexp_replace(html, '<script>.*?</script>|<style>.*?</style>|<!--.*?-->', '', 'gs') AS html FROM pages),
article AS (SELECT page_id, regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<p><b>(.*?)<br>', '<div class="' ||
    CASE WHEN page_id % 5 = 0 THEN 'wide comic-image' ELSE 'wide' END ||
    '"><div><img src="/a.png"><img class="emoji" src="/e.png"></div><img src="/b.png"></div>\1', 'gs') AS html FROM body),
piece AS (SELECT page_id, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS idx
  FROM (SELECT page_id, regexp_extract_all(html, '<[^>]*>|[^<]+') AS p FROM article)),
moved AS (SELECT *, CASE WHEN piece LIKE '</%' THEN -1 WHEN piece LIKE '<%' AND piece NOT LIKE '<img%' THEN 1 ELSE 0 END AS step FROM piece),
deep AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY idx) - step AS depth FROM moved),
cut AS (SELECT *, sum(CASE WHEN depth = 0 AND step >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY idx) AS block,
  CASE WHEN piece LIKE '<img%' AND piece NOT LIKE '%emoji%' THEN 1 ELSE 0 END AS img,
  CASE WHEN piece LIKE '<%' THEN 0 ELSE length(trim(replace(replace(replace(replace(
    replace(piece, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&middot;', '·'), '&amp;', '&'))) END AS prose FROM deep),
said AS (SELECT page_id, block AS idx, CASE WHEN sum(prose) > 0 THEN 0 ELSE sum(img) END AS image, sum(prose) AS prose,
  bool_or(piece LIKE '%comic-image%') AS comic FROM cut GROUP BY ALL),
edge_of AS (SELECT page_id, min(idx) FILTER (WHERE image > 0) AS lo, max(idx) FILTER (WHERE image > 0) AS hi, sum(image) AS images,
  bool_or(comic) AS comic, arg_min(image, idx) FILTER (WHERE comic) AS first FROM said GROUP BY page_id),
own AS (SELECT p.page_id, coalesce(any_value(CASE WHEN e.comic THEN first ELSE images END), 0) AS images,
               CASE WHEN any_value(e.comic) THEN 0 ELSE coalesce(sum(prose) FILTER (WHERE image = 0 AND idx BETWEEN lo AND hi), 0) END AS prose
        FROM pages p LEFT JOIN edge_of e USING (page_id) LEFT JOIN said USING (page_id) GROUP BY p.page_id),
tag AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1) AS lang, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS h1,
               regexp_extract_all(html, '<a href="/([^"]*)">', 1) AS tags FROM pages)
"""


def _bodies(spark, folder):
    """Article bodies: each bold heading becomes a nested block of images, an emoji among them, with bare text after it."""
    kind = F.when(F.col("page_id") % 5 == 0, "wide comic-image").otherwise("wide")
    images = F.concat(
        F.lit('<div class="'), kind, F.lit('"><div><img src="/a.png"><img class="emoji" src="/e.png"></div><img src="/b.png"></div>$1')
    )
    article = F.regexp_extract(links.visible(F.col("html")), "(?s)<article>(.*?)</article>", 1)
    body = F.regexp_replace(article, F.lit("(?s)<p><b>(.*?)<br>"), images)
    tags = F.transform(links.hrefs(F.col("html")), lambda h: F.substr(h, F.lit(2)))
    return views.pages(spark, folder).select(
        "page_id",
        U.path_group(F.col("url"), "^/([a-z]+)/").alias("lang"),
        links.own_pages(links.article_blocks(body)).alias("own"),
        tags.alias("tags"),
    )


@query(
    "l7_own_pages",
    sql(body=_BLOCKS + "SELECT page_id, CAST(images AS INT) AS images, CAST(prose AS INT) AS prose FROM own"),
)
def l7(spark, folder):
    """The page images of an article's body, and the prose between the first and the last of them."""
    return _bodies(spark, folder).select("page_id", "own.images", "own.prose")


@query(
    "l8_comic_or_text",
    sql(
        body=_BLOCKS
        + """SELECT page_id, images > 0 AND (lang = 'fr' OR (prose <= 30 * images AND
    len(list_filter(tags, lambda t: contains(t, 'the') OR contains(t, 'der') OR contains(t, 'la') OR contains(t, 'de'))) > 0)) AS is_comic
FROM own JOIN tag USING (page_id)""",
    ),
)
def l8(spark, folder):
    category = F.when(F.col("lang") == "fr", F.lit("comic")).otherwise(F.col("lang"))
    comic = links.is_comic(F.col("own.images"), F.col("own.prose"), category, F.col("tags"), GENRE_WORDS)
    return _bodies(spark, folder).select("page_id", comic.alias("is_comic"))


@query(
    "l9_series_of_tags",
    r"""
WITH tag AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1) AS lang,
    list_filter(regexp_extract_all(html, '<a href="/([^"]*)">', 1), lambda t:
       NOT (contains(t, 'the') OR contains(t, 'der') OR contains(t, 'la') OR contains(t, 'de'))) AS own FROM pages)
SELECT page_id, coalesce(own[1], CASE WHEN lang <> 'en' THEN lang END, 'site') AS series FROM tag""",
)
def l9(spark, folder):
    writers = F.filter(F.array("lang"), lambda w: w != "en")
    series = links.series_of_tags(F.col("tags"), writers, "site", GENRE_WORDS)
    return _bodies(spark, folder).select("page_id", series.alias("series"))


_LABELS = r"""
WITH raw AS (SELECT page_id, lower(regexp_extract(origin, '//(.*)$', 1)) AS host, lower(href) AS link, idx,
    CASE WHEN regexp_matches(href, '^/[A-Z]') THEN '' WHEN length(href) < 4 THEN '[見開き]' ELSE substr(href, 2) END AS label FROM anchor)
"""


def _labelled(spark, folder):
    """Anchors whose label depends on their spelling: capitals carry an image only, short ones a filler."""
    found = F.posexplode(links.anchors(F.col("html"))).alias("at", "anchor")
    pages = views.pages(spark, folder).select("page_id", U.host(F.col("url")).alias("host"), found)
    href = F.col("anchor.href")
    label = (
        F.when(href.rlike("^/[A-Z]"), F.lit(""))
        .when(F.length(href) < 4, F.lit("[見開き]"))
        .otherwise(F.col("anchor.text"))
    )
    return pages.select("page_id", "host", F.lower(href).alias("link"), "at", label.alias("label"))


@query(
    "l10_first_label",
    sql(
        "anchor",
        body=_LABELS
        + """SELECT host, link, coalesce(arg_min(label, page_id * 1000 + idx) FILTER (WHERE label NOT IN ('', '[見開き]')), '') AS label
FROM raw GROUP BY host, link""",
    ),
)
def l10_first(spark, folder):
    found = _labelled(spark, folder)
    return links.first_label(found, ["host", "link"], "label", ["page_id", "at"], ("[見開き]",))


@query(
    "l10_longest_label",
    sql(
        "anchor",
        body=_LABELS
        + """SELECT host, link, first(label ORDER BY length(label) DESC, page_id, idx) AS label FROM raw GROUP BY host, link""",
    ),
)
def l10_longest(spark, folder):
    found = _labelled(spark, folder)
    return links.longest_label(found, ["host", "link"], "label", ["page_id", "at"])
