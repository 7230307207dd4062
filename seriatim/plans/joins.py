"""Queries on joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriatim.functions import dates as D
from seriatim.functions import urls as U
from seriatim.operators import joins, links, ordered
from seriatim.plans import views
from seriatim.plans.registry import Registry
from seriatim.plans.views import sql
from seriatim.sources import sinks
from seriatim.sources.shared import new_path
from seriatim.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.query


@query(
    "j1_as_of_start",
    """
SELECT p.event_id, CASE WHEN p.event_type IN ('view', 'click')
    THEN (SELECT max(s.event_id) FROM events s WHERE s.user_id = p.user_id AND s.event_type = 'signup' AND s.event_id <= p.event_id)
    ELSE (SELECT min(s.event_id) FROM events s WHERE s.user_id = p.user_id AND s.event_type = 'purchase' AND s.props = p.props) END AS start
FROM events p WHERE p.event_type IN ('view', 'click', 'error')""",
)
def j1(spark, folder):
    """Views and clicks take the sign-up at or before them, errors only a purchase of the same name."""
    events = table(spark, folder, "events", "event_id", "user_id", "event_type", "props")
    kind = F.col("event_type")
    pages = events.where(kind.isin("view", "click", "error")).select(
        "event_id", "user_id", F.when(kind != "error", F.col("event_id")).alias("number"), F.col("props").alias("name")
    )
    starts = events.where(kind.isin("signup", "purchase")).select(
        "user_id",
        F.when(kind == "signup", F.col("event_id")).alias("number"),
        F.col("props").alias("name"),
        F.col("event_id").alias("start"),
    )
    return joins.as_of(pages, starts, ["user_id"], "number", "name", "start").select("event_id", "start")


@query(
    "j2_locked_from_listing",
    sql(
        "episode",
        body="""
WITH place AS (SELECT episode_id, label, listed, row_number() OVER w AS n, lag(episode_id) OVER w AS b, lead(episode_id) OVER w AS a
  FROM listing WINDOW w AS (PARTITION BY series_id ORDER BY pos))
SELECT e.episode_id, CASE WHEN readable THEN 'own ' || e.episode_id ELSE p.label END AS title,
  p.n AS number, p.b AS before, p.a AS after, CASE WHEN readable THEN NULL ELSE p.listed END AS published
FROM episode e LEFT JOIN place p USING (episode_id)""",
    ),
)
def j2(spark, folder):
    """Locked episodes described by their series' listing, readable ones by themselves."""
    episodes = views.episode(spark, folder).select(
        "episode_id",
        "readable",
        F.when(F.col("readable"), F.concat(F.lit("own "), F.col("episode_id").cast("string"))).alias("title"),
        F.lit(None).cast("date").alias("published"),
    )
    listed = views.listing(spark, folder).select("series_id", "pos", "episode_id", "label", "listed")
    outputs = {"number": ordered.place(), "before": ordered.before("episode_id"), "after": ordered.after("episode_id")}
    placed = ordered.scan(listed, ["series_id"], "pos", outputs).select(
        "episode_id", F.col("label").alias("title"), F.col("listed").alias("published"), "number", "before", "after"
    )
    fields = ["title", "published", "number", "before", "after"]
    return joins.filled_from_listing(episodes, placed, "episode_id", "readable", fields, always=fields[2:]).drop("readable")


@query(
    "j3_first_kind",
    """
SELECT l_suppkey AS series_id, l_partkey AS item, min(CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END) AS kind,
  arg_min(l_orderkey, CASE l_linestatus WHEN 'O' THEN 0 ELSE 1000000000 END + l_orderkey) AS pos FROM lineitem GROUP BY ALL""",
)
def j3(spark, folder):
    """Each item from the episode list, else from the volume list."""
    lines = table(spark, folder, "lineitem", "l_suppkey", "l_partkey", "l_orderkey", "l_linestatus")
    named = lines.select(
        F.col("l_suppkey").alias("series_id"), F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("pos"), "l_linestatus"
    )
    return joins.first_kind(
        named.where("l_linestatus = 'O'"), named.where("l_linestatus <> 'O'"), key=["series_id", "item"], keep=["pos"]
    )


@query(
    "j4_dated_by_upload",
    sql(
        "episode",
        body="""
WITH first AS (SELECT l_orderkey AS episode_id, first(l_shipdate ORDER BY l_linenumber, l_shipdate) AS up FROM lineitem GROUP BY 1)
SELECT e.episode_id, coalesce(CASE WHEN e.priority NOT LIKE '2-%' THEN e.published END,
    CASE WHEN e.n_pages > 0 THEN CAST(f.up + INTERVAL 9 HOUR AS DATE) END) AS published
FROM episode e LEFT JOIN first f USING (episode_id)""",
    ),
)
def j4(spark, folder):
    """Undated episodes dated by the Last-Modified header of their first page."""
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate")
    pages = lines.select(F.col("l_orderkey").alias("episode_id"), F.col("l_linenumber").alias("page_no"), F.col("l_shipdate").alias("at"))
    first = ordered.first_of_each(pages, ["episode_id"], "page_no", ["at"], ties=["at"])
    header = F.date_format("at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    uploads = first.select("episode_id", D.http_day(header).alias("uploaded"))
    undated = F.when(~F.col("priority").like("2-%"), F.col("published"))
    episodes = views.episode(spark, folder).select("episode_id", "n_pages", undated.alias("published"))
    return joins.dated_by_upload(episodes, uploads, "episode_id", "published", "uploaded", "n_pages").drop("n_pages")


@query(
    "j5_list_holding_key",
    r"""
WITH body AS (SELECT page_id, lower(regexp_extract(html, '<a href="/([^"]*)">', 1)) AS key,
    list_transform(regexp_extract_all(html, '<p>(.*?)</p>', 1), lambda p: string_split(lower(p), ' ')) AS lists FROM pages)
SELECT page_id, key, len(coalesce(list_filter(lists, lambda l: list_contains(l, key))[1], [])) AS n_words FROM body""",
)
def j5(spark, folder):
    """The first paragraph holding the page's own key, as a list of words."""
    key = F.lower(F.substr(F.get(links.hrefs(F.col("html")), F.lit(0)), F.lit(2)))
    paragraphs = F.regexp_extract_all("html", F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))
    pages = views.pages(spark, folder).select(
        "page_id", key.alias("key"), F.transform(paragraphs, lambda p: F.split(F.lower(p), " ")).alias("lists")
    )
    held = joins.list_holding(F.col("lists"), F.col("key"))
    return pages.select("page_id", "key", F.size(held).alias("n_words"))


@query(
    "j6_merged_runs",
    sql(
        "listing",
        body="SELECT series_id, episode_id, pos, row_number() OVER (PARTITION BY series_id ORDER BY pos) AS place FROM listing",
    ),
)
def j6_runs(spark, folder):
    """Early, middle and latest runs that overlap, made one listing again."""
    listed = views.listing(spark, folder).select("series_id", "episode_id", "pos", "priority")
    runs = [
        listed.where(F.substring("priority", 1, 1).isin(*held)).drop("priority")
        for held in (("1", "2", "3"), ("2", "3", "4"), ("4", "5"))
    ]
    return joins.merged_runs(*runs, group=["series_id"], item="episode_id", order="pos")


@query(
    "j6_preferred_or_else",
    sql(
        "listing",
        body="""
SELECT series_id, episode_id, pos FROM listing WHERE priority LIKE '1-%'
UNION ALL SELECT series_id, episode_id, pos FROM listing l WHERE priority NOT LIKE '1-%'
  AND NOT EXISTS (SELECT 1 FROM listing p WHERE p.series_id = l.series_id AND p.priority LIKE '1-%')""",
    ),
)
def j6_fallback(spark, folder):
    listed = views.listing(spark, folder).select("series_id", "episode_id", "pos", "priority")
    first = F.col("priority").like("1-%")
    preferred, second = (listed.where(which).drop("priority") for which in (first, ~first))
    return joins.preferred_or_else(preferred, second, ["series_id"])


@query(
    "j6_older_prepended",
    sql(
        "listing",
        body="""
WITH shown AS (SELECT series_id, count(*) AS n, min(pos) AS lo FROM listing WHERE listed >= DATE '1999-01-01' GROUP BY series_id),
kept AS (SELECT l.series_id, l.episode_id, l.pos FROM listing l JOIN shown s USING (series_id)
  WHERE l.listed >= DATE '1999-01-01' OR (s.n >= 3 AND l.pos < s.lo))
SELECT series_id, episode_id, row_number() OVER (PARTITION BY series_id ORDER BY pos) AS place FROM kept""",
    ),
)
def j6_older(spark, folder):
    """Recent episodes are listed; of a listing with three or more the previous links lead on to older ones.

    Older episodes between listed ones are not asked for: the walk starts at
    the first listed one.
    """
    listed = views.listing(spark, folder).where("listed >= DATE '1999-01-01'").select("series_id", "episode_id", "pos")
    edges = views.edge(spark, folder).select("node", "prev_node")
    return joins.prepend_older(listed, edges, "series_id", "pos", "episode_id", "node", "prev_node", 3)


@query(
    "j7_episodes_of_authors",
    """
SELECT c_nationkey AS author_id, o_custkey AS work_id, o_orderkey AS episode_id,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, o_custkey, o_orderkey) AS place
FROM customer JOIN orders ON o_custkey = c_custkey""",
)
def j7(spark, folder):
    customer = table(spark, folder, "customer", "c_custkey", "c_nationkey", "c_acctbal")
    works = customer.select(
        F.col("c_nationkey").alias("author_id"), F.col("c_custkey").alias("work_id"), F.col("c_acctbal").alias("work_pos")
    )
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey")
    episodes = orders.select(F.col("o_custkey").alias("work_id"), F.col("o_orderkey").alias("episode_id"))
    listed = joins.episodes_of_authors(works, episodes, "author_id", "work_id", "work_pos", "episode_id")
    return listed.select("author_id", "work_id", "episode_id", "place")


_SAVED = "SELECT DISTINCT l_orderkey AS episode_id FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'"


def _saved(spark, folder):
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_shipdate").where("l_shipdate < TIMESTAMP_NTZ '1997-01-01'")
    return lines.select(F.col("l_orderkey").alias("episode_id"))


@query("j8_saved_already", sql("listing", body=f"SELECT series_id, episode_id FROM listing WHERE episode_id IN ({_SAVED})"))
def j8_saved(spark, folder):
    listed = views.listing(spark, folder).select("series_id", "episode_id")
    return joins.saved_already(listed, _saved(spark, folder), "episode_id")


@query("j8_not_saved_yet", sql("listing", body=f"SELECT series_id, episode_id FROM listing WHERE episode_id NOT IN ({_SAVED})"))
def j8_to_fetch(spark, folder):
    listed = views.listing(spark, folder).select("series_id", "episode_id")
    return joins.not_saved_yet(listed, _saved(spark, folder), "episode_id")


@query("j8_new_beside_catalogue", sql("listing", body=f"SELECT series_id, episode_id FROM listing WHERE episode_id NOT IN ({_SAVED})"))
def j8_beside(spark, folder):
    """The same, held against a catalogue of what is saved that lies by key."""
    listed = views.listing(spark, folder).select("series_id", "episode_id")
    path = new_path(spark, "saved")
    name = "saved_" + path.rpartition("-")[2]
    saved = sinks.write_saved(_saved(spark, folder), name, path, "episode_id", buckets=8)
    return joins.not_saved_yet(listed, saved, "episode_id", by_key=True)


@query(
    "j9_listing_by_frame",
    sql(
        "anchor",
        body=r"""
WITH shaped AS (SELECT page_id AS frame, href AS work, idx FROM anchor WHERE regexp_matches(href, '^/[a-z]{4,6}$')),
first AS (SELECT frame, arg_min(work, idx) AS work FROM shaped GROUP BY frame),
listed AS (SELECT work, count(*) AS entries FROM shaped GROUP BY work)
SELECT p.page_id, CAST(regexp_extract(p.url, '/([0-9]+)', 1) AS BIGINT) AS frame, f.work, l.entries
FROM pages p LEFT JOIN first f ON f.frame = CAST(regexp_extract(p.url, '/([0-9]+)', 1) AS BIGINT) LEFT JOIN listed l ON l.work = f.work""",
    ),
)
def j9(spark, folder):
    """A page names the page whose id its URL carries as its frame; many name one that never landed."""
    frame = U.path_group(F.col("url"), r"/([0-9]+)").cast("bigint").alias("frame")
    readers = views.pages(spark, folder, "page_id", "url").select("page_id", frame)
    found = F.posexplode(links.hrefs(F.col("html"))).alias("at", "work")
    shaped = (
        views.pages(spark, folder, "page_id", "html")
        .select(F.col("page_id").alias("frame"), found)
        .where(F.col("work").rlike("^/[a-z]{4,6}$"))
    )
    listings = shaped.groupBy("work").agg(F.count(F.lit(1)).alias("entries"))
    return joins.listing_by_frame(readers, shaped, listings, "frame", "work", "at")


@query(
    "j10_merged_links",
    sql(
        "edge",
        "episode",
        body="""
WITH shown AS (SELECT episode_id, lag(episode_id) OVER w AS b, lead(episode_id) OVER w AS a FROM listing WHERE open
  WINDOW w AS (PARTITION BY series_id ORDER BY pos))
SELECT e.node AS episode_id, coalesce(s.a, e.next_node) AS listing_first,
  coalesce(e.next_node, CASE WHEN p.n_pages = 0 THEN s.a END) AS record_first,
  CASE WHEN p.priority LIKE '5-%' THEN s.a ELSE s.b END AS swapped_before, CASE WHEN p.priority LIKE '5-%' THEN s.b ELSE s.a END AS swapped_after
FROM edge e JOIN episode p ON p.episode_id = e.node LEFT JOIN shown s ON s.episode_id = e.node""",
    ),
)
def j10(spark, folder):
    """Next links told by the record and by a listing of open episodes, merged in each site's order."""
    listed = views.listing(spark, folder).where("open").select("series_id", "pos", "episode_id")
    shown = ordered.neighbours(listed, ["series_id"], "pos", "episode_id", "before", "after").drop("series_id", "pos")
    record = views.edge(spark, folder).select(F.col("node").alias("episode_id"), "next_node")
    facts = views.episode(spark, folder).select("episode_id", "n_pages", "priority")
    told = record.join(facts, "episode_id").join(shown, "episode_id", "left")
    nxt, after = F.col("next_node"), F.col("after")
    before_, after_ = joins.swapped(F.col("before"), after, F.col("priority").like("5-%"))
    return told.select(
        "episode_id",
        joins.merged_links(nxt, after, listing_first=True).alias("listing_first"),
        joins.merged_links(nxt, after, only_without_pages=F.col("n_pages")).alias("record_first"),
        before_.alias("swapped_before"),
        after_.alias("swapped_after"),
    )
