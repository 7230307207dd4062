"""Queries on walks along links."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriatim.operators import chain, ordered
from seriatim.plans import views
from seriatim.plans.registry import Registry
from seriatim.plans.views import sql
from seriatim.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.query

_RANKED = """
WITH rank AS (SELECT l.series_id, l.episode_id AS node, row_number() OVER w AS r, count(*) OVER (PARTITION BY l.series_id) AS n,
    last_value(l.priority) OVER (PARTITION BY l.series_id ORDER BY l.pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_priority
  FROM listing l WINDOW w AS (PARTITION BY l.series_id ORDER BY l.pos)),
seed AS (SELECT series_id, min(episode_id) AS seed FROM listing WHERE NOT open GROUP BY series_id),
placed AS (SELECT r.*, s.seed, q.r AS sr FROM rank r JOIN seed s USING (series_id) JOIN rank q ON q.node = s.seed)
"""


def _seeds(spark, folder):
    """One walk per series, from its first locked episode."""
    locked = views.listing(spark, folder).where("NOT open")
    return locked.groupBy("series_id").agg(F.min("episode_id").alias("seed"))


@query(
    "g1_forward_chain",
    sql(
        "listing",
        body=_RANKED
        + """SELECT series_id, seed, node, CASE WHEN r >= sr THEN r - sr ELSE n - sr + r END AS depth FROM placed
WHERE r >= sr OR last_priority LIKE '2-%'""",
    ),
)
def g1(spark, folder):
    """On from the first locked episode; a series whose end links back is walked round once."""
    return chain.walk(views.edge(spark, folder), _seeds(spark, folder), "node", "next_node", "seed")


@query(
    "g2_both_directions",
    sql("listing", body=_RANKED + "SELECT series_id, seed, node, r - sr AS depth FROM placed"),
)
def g2(spark, folder):
    return chain.both_ways(views.edge(spark, folder), _seeds(spark, folder), "node", "prev_node", "next_node", "seed")


@query(
    "g3_link_audit",
    sql(
        "edge",
        body="""
WITH pair AS (SELECT node, prev_node AS link FROM edge UNION ALL SELECT node, next_node FROM edge)
SELECT node, link, 'dangling' AS problem FROM pair WHERE link IS NOT NULL AND link NOT IN (SELECT node FROM edge)
UNION ALL SELECT e.node, e.next_node, 'one-way' FROM edge e JOIN edge t ON t.node = e.next_node WHERE t.prev_node IS DISTINCT FROM e.node""",
    ),
)
def g3(spark, folder):
    return chain.link_audit(views.edge(spark, folder), "node", "prev_node", "next_node")


@query(
    "g3_in_cycles",
    sql("listing", body="WITH last AS (SELECT series_id, arg_max(priority, pos) AS p FROM listing GROUP BY 1) SELECT episode_id AS node FROM listing JOIN last USING (series_id) WHERE p LIKE '2-%'"),
)
def g3_cycles(spark, folder):
    return chain.in_cycles(views.edge(spark, folder), "node", "next_node")


@query(
    "g4_page_walk",
    """
WITH page AS (SELECT l_orderkey AS episode_id, l_linenumber AS page_no, bool_and(l_returnflag = 'R') AS blank FROM lineitem GROUP BY ALL),
stop AS (SELECT episode_id, min(page_no) FILTER (WHERE blank) AS stop FROM page GROUP BY episode_id)
SELECT episode_id, page_no, row_number() OVER (PARTITION BY episode_id ORDER BY page_no) - 1 AS depth
FROM page JOIN stop USING (episode_id) WHERE stop IS NULL OR page_no < stop""",
)
def g4(spark, folder):
    """Pages of an episode along their next links, up to the first without an image.

    An episode whose first page has none is no episode.
    """
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    pages = lines.groupBy(F.col("l_orderkey").alias("episode_id"), F.col("l_linenumber").alias("page_no")).agg(
        F.every(F.col("l_returnflag") == "R").alias("blank")
    )
    numbered = pages.withColumn("page", F.col("episode_id") * 10 + F.col("page_no"))
    edges = ordered.neighbours(numbered, ["episode_id"], "page_no", "page", "prev_page", "next_page")
    seeds = pages.groupBy("episode_id").agg(F.min("page_no").alias("first")).select(
        "episode_id", (F.col("episode_id") * 10 + F.col("first")).alias("seed")
    )
    walked = chain.walk(edges, seeds, "page", "next_page", "seed", stop="blank")
    return walked.select("episode_id", (F.col("page") - F.col("episode_id") * 10).cast("int").alias("page_no"), "depth")


@query(
    "g4_titled_walk",
    sql(
        "edge",
        body="""
WITH RECURSIVE page AS (SELECT e.node, e.next_node, NOT l.open AS starts, l.priority LIKE '5-%' AS title FROM edge e JOIN listing l ON l.episode_id = e.node),
walk AS (SELECT node AS seed, node, 0 AS depth FROM page WHERE starts
  UNION ALL SELECT w.seed, t.node, w.depth + 1 FROM walk w JOIN page p ON p.node = w.node JOIN page t ON t.node = p.next_node
  WHERE NOT t.starts AND t.title = p.title)
SELECT seed, node, CAST(depth AS BIGINT) AS depth FROM walk""",
    ),
)
def g4_titled(spark, folder):
    """A walk from every listed start, up to where the title changes or another listed start comes."""
    listed = views.listing(spark, folder).select(
        F.col("episode_id").alias("node"), "open", F.col("priority").like("5-%").alias("title")
    )
    starts = listed.where("NOT open").select("node")
    pages = views.edge(spark, folder).select("node", "next_node").join(listed.drop("open"), "node")
    inside = chain.links_inside(pages, "node", "next_node", "title", starts)
    return chain.walk(inside, starts.withColumnRenamed("node", "seed"), "node", "next_node", "seed")
