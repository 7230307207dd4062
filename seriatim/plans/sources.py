"""Queries on sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriatim.functions import urls as U
from seriatim.operators import links, ordered
from seriatim.plans import views
from seriatim.plans.registry import Registry
from seriatim.plans.views import sql
from seriatim.sources import crawl, sinks
from seriatim.sources.shared import new_path
from seriatim.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.query


@query(
    "s1_page_scan",
    "SELECT page_id, split_part(url, '#', 1) AS base_url, length(html) AS n_chars FROM pages",
)
def s1(spark, folder):
    """Every landed page with the URL its links resolve against."""
    return views.pages(spark, folder).select(
        "page_id", U.drop_fragment(F.col("url")).alias("base_url"), F.length("html").alias("n_chars")
    )


@query(
    "s2_embedded_json",
    """
SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS listed,
  CASE WHEN event_type = 'click' THEN event_id END AS attributed FROM events WHERE event_type NOT IN ('error', 'view')""",
)
def s2(spark, folder):
    """JSON from a script element, an assignment and an attribute; broken and absent ones give no rows."""
    events = table(spark, folder, "events", "event_id", "event_type", "props")
    kind, props = F.col("event_type"), F.col("props")
    body = F.when(kind == "error", F.substr(props, F.lit(1), F.length(props) - 1)).otherwise(props)
    script = F.when(kind != "view", F.concat(F.lit('<script type="application/json" id="comic-data">'), body, F.lit("</script>")))
    value = F.when(
        kind == "click",
        F.concat(F.lit('<div data-value="{&quot;id&quot;: '), F.col("event_id").cast("string"), F.lit('}"></div>')),
    )
    html = F.concat_ws(
        "", F.lit("<html>"), script, F.lit("<script>const chapters = ["), props, F.lit("];</script>"), value, F.lit("</html>")
    )
    paged = events.select("event_id", html.alias("html"))
    held = F.col("html")
    read = paged.select(
        "event_id",
        F.try_variant_get(crawl.script_json(held, "comic-data"), "$.k", "int").alias("k"),
        F.try_variant_get(crawl.assigned_json(held, "chapters"), "$[0].k", "int").alias("listed"),
        F.try_variant_get(crawl.attribute_json(held, "data-value"), "$.id", "bigint").alias("attributed"),
    )
    return read.where(F.col("k").isNotNull())


@query(
    "s3_feed_listing",
    sql(
        "anchor",
        body="""
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY idx) AS pos, origin || href AS link
FROM anchor WHERE NOT regexp_matches(href, '^/[A-Z]')""",
    ),
)
def s3(spark, folder):
    """A feed made of every page's anchors; capitalised ones become items with an empty link."""
    links_of = F.transform(
        F.col("hrefs"),
        lambda h: F.concat(
            F.lit("<item><title>x</title><link> "),
            F.when(h.rlike("^/[A-Z]"), F.lit("")).otherwise(F.concat(F.col("origin"), h, F.lit("?from=rss#top"))),
            F.lit(" </link></item>"),
        ),
    )
    feeds = (
        views.pages(spark, folder)
        .select("page_id", U.origin(F.col("url")).alias("origin"), links.hrefs(F.col("html")).alias("hrefs"))
        .select("page_id", F.concat(F.lit("<rss><channel>"), F.array_join(links_of, ""), F.lit("</channel></rss>")).alias("xml"))
    )
    return crawl.feed_listing(feeds, "xml", cut_query=True)


@query(
    "s4_works_catalogue",
    """
WITH row AS (SELECT p_partkey, p_name, CASE WHEN p_size < 5 THEN '' ELSE p_brand || ' (原作)' END AS a,
    CASE WHEN p_type = 'PROMO' THEN p_type ELSE '' END AS b FROM part),
held AS (SELECT p_partkey, p_name, CASE WHEN a = '' THEN b WHEN b = '' THEN a ELSE a || ', ' || b END AS credits FROM row)
SELECT p_name AS title, arg_max(credits, p_partkey) AS credits FROM held WHERE credits <> '' GROUP BY p_name""",
)
def s4(spark, folder):
    """CSV lines of works and their credits; a later line of the same title wins."""
    part = table(spark, folder, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    name = F.when(F.col("p_size") < 5, F.lit("")).otherwise(F.col("p_brand"))
    third = F.when(F.col("p_type") == "PROMO", F.col("p_type")).otherwise(F.lit(""))
    text = F.concat_ws(",", F.concat(F.lit('" '), F.col("p_name"), F.lit('"')), name, F.lit(""), third, F.lit("原作"), F.lit("作画"), F.lit(""))
    schema = ", ".join(f"`{column}` string" for column in crawl.CATALOGUE)
    lines = part.select(F.col("p_partkey").alias("line"), F.from_csv(text, schema).alias("held"))
    return crawl.catalogue_credits(lines.select("line", "held.*"))


@query(
    "s5_nested_chapters",
    r"""
WITH chapter AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS chapter FROM documents),
entry AS (SELECT doc_id, chapter, list_concat(string_split(line, '. '), CASE WHEN line LIKE '%?' THEN ['extra'] ELSE [] END) AS entries FROM chapter)
SELECT doc_id, CAST(chapter AS INT) AS chapter, unnest(range(1, len(entries) + 1)) AS place, length(unnest(entries)) AS n_chars FROM entry""",
)
def s5(spark, folder):
    """Documents as works: lines are chapters, sentences episodes; a line ending in ``?`` has an extra one."""
    chapters = F.transform(
        F.split("text", "\n"),
        lambda line: F.struct(
            F.split(line, r"\. ").alias("episodes"), F.when(F.endswith(line, F.lit("?")), F.lit("extra")).alias("extra")
        ),
    )
    works = table(spark, folder, "documents", "doc_id", "text").select("doc_id", chapters.alias("chapters"))
    flat = crawl.chapter_entries(works, "chapters")
    return flat.select("doc_id", "chapter", "place", F.length("entry").alias("n_chars"))


@query(
    "s6_json_api",
    """
SELECT o_orderkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS episode_id, o_custkey AS order_no, o_orderpriority AS title,
  CASE WHEN o_orderstatus <> 'P' THEN 'c' || o_custkey END AS work_id FROM orders WHERE o_orderpriority NOT LIKE '1-%'""",
)
def s6(spark, folder):
    """One document per order: an episode, a resource without attributes, included author and work."""
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    key, cust, priority = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderpriority")

    def resource(ident, kind, attributes):
        return F.struct(ident.alias("id"), F.lit(kind).alias("type"), attributes.alias("attributes"))

    titled = F.create_map(F.lit("title"), priority)
    placed = F.create_map(F.lit("title"), priority, F.lit("sort_volume"), cust)
    none = F.lit(None).cast("map<string,string>")
    episode = resource(key, "episode", F.when(priority.like("1-%"), titled).otherwise(placed))
    kind = F.when(F.col("o_orderstatus") == "P", F.lit("author")).otherwise(F.lit("comic"))
    work = F.struct(F.concat(F.lit("c"), cust).alias("id"), kind.alias("type"), titled.alias("attributes"))
    body = F.to_json(
        F.struct(
            F.array(episode, resource(F.lit("x"), "episode", none)).alias("data"),
            F.array(resource(F.lit("a"), "author", titled), work).alias("included"),
        )
    )
    read = crawl.json_api(orders.select(F.col("o_orderkey").alias("doc_id"), body.alias("body")), "body", "comic", "sort_volume")
    return read.select("doc_id", "episode_id", "order_no", F.element_at("attributes", "title").alias("title"), "work_id")


_CATALOGUE = """
SELECT e.episode_id, s.title AS series, e.label AS title, e.published, e.n_pages, e.readable, s.host
FROM episode e JOIN series s USING (series_id)"""


def _catalogue(spark, folder):
    """Episode records: the episode with its series' title and host."""
    return (
        views.episode(spark, folder)
        .join(views.series(spark, folder), "series_id")
        .select(
            "episode_id",
            F.col("title").alias("series"),
            F.col("label").alias("title"),
            "published",
            "n_pages",
            "readable",
            "writer",
            "host",
        )
    )


@query(
    "s7_episode_catalogue",
    sql("episode", "series", body=_CATALOGUE),
)
def s7(spark, folder):
    """Episode records written as JSON by host, then read back as they were written."""
    records = _catalogue(spark, folder).drop("writer")
    path = new_path(spark, "episodes")
    sinks.write_episodes(records, path)
    return spark.read.schema(records.schema).json(path)


_MANIFEST = """
SELECT episode_id, page_no, image, row_number() OVER (PARTITION BY episode_id ORDER BY page_no) - 1 AS page_index,
    count(*) OVER (PARTITION BY episode_id) AS page_count FROM page_row"""


@query(
    "s8_page_manifest",
    sql(
        "page_row",
        "episode",
        "series",
        body=f"""
SELECT m.episode_id, m.page_no, s.host || '/' || s.title || '/' || e.label || '/' ||
  lpad(CAST(m.page_index AS VARCHAR), CAST(length(CAST(m.page_count AS VARCHAR)) AS INT), '0') || '.jpg' AS file
FROM ({_MANIFEST}) m JOIN episode e USING (episode_id) JOIN series s USING (series_id)""",
    ),
)
def s8(spark, folder):
    """Every page's file: host, series, episode, number."""
    pages = sinks.page_manifest(views.page_row(spark, folder), "episode_id", "page_no")
    titles = views.series(spark, folder).select("series_id", "host", "title")
    named = views.listing(spark, folder).select("series_id", "episode_id", "label").join(titles, "series_id")
    folders = named.select(
        "episode_id",
        sinks.episode_folder(F.col("host"), F.lit("rule"), F.col("title"), F.col("label")).alias("folder"),
    )
    return pages.join(folders, "episode_id").select(
        "episode_id", "page_no", F.concat_ws("/", "folder", "file_name").alias("file")
    )


@query(
    "s8_first_page_manifest",
    sql("page_row", body="SELECT episode_id, min(page_no) AS page_no, arg_min(image, page_no) AS image, '0.jpg' AS file_name FROM page_row GROUP BY episode_id"),
)
def s8_first(spark, folder):
    first = sinks.page_manifest(views.page_row(spark, folder), "episode_id", "page_no", only_first=True)
    return first.drop("page_index", "page_count")


@query(
    "s9_archive_descriptors",
    sql(
        "episode",
        "series",
        body="""
SELECT e.episode_id, e.label AS title, s.title AS series, row_number() OVER (PARTITION BY e.series_id ORDER BY e.pos) AS number,
  s.writer, s.host AS publisher, year(e.published) AS year, month(e.published) AS month, day(e.published) AS day,
  'https://' || s.host || '/episode/' || e.episode_id AS web, 'yes' AS manga, 'ja' AS language, e.n_pages AS page_count
FROM (SELECT * FROM episode WHERE n_pages > 0) e JOIN series s USING (series_id)""",
    ),
)
def s9(spark, folder):
    """Archive descriptors of the episodes that have pages, numbered among them."""
    counts = views.page_count(spark, folder).withColumnRenamed("n_pages", "page_count")
    listed = views.listing(spark, folder).join(counts, "episode_id", "left_semi")
    numbered = ordered.number_rows(listed, ["series_id"], "pos", "number")
    facts = numbered.join(views.series(spark, folder), "series_id").select(
        "episode_id",
        F.col("label").alias("title"),
        F.col("title").alias("series"),
        "number",
        "writer",
        F.col("host").alias("publisher"),
        F.col("listed").alias("published"),
        F.concat(F.lit("https://"), F.col("host"), F.lit("/episode/"), F.col("episode_id").cast("string")).alias("url"),
    )
    return sinks.archive_descriptors(facts, counts, "episode_id")


@query(
    "s10_pages_by_count",
    sql(
        "episode",
        body="""
SELECT episode_id, n AS page_no, 'https://img.example.com/' || episode_id || '/' || n || '.jpg' AS page_url
FROM (SELECT episode_id, unnest(range(1, n_pages + 1)) AS n FROM episode)""",
    ),
)
def s10(spark, folder):
    base = F.concat(F.lit("https://img.example.com/"), F.col("episode_id").cast("string"), F.lit("/"))
    counted = views.episode(spark, folder).select("episode_id", "n_pages", base.alias("base"))
    return crawl.pages_by_count(counted, "base", "n_pages").select("episode_id", "page_no", "page_url")
