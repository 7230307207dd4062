"""The crawl tables as a catalogue: pages, rules, listings, episodes, page lists, links, watch list.

Every view exists twice, as DataFrame (function) and as SQL (``SQL``), from
whole tables: a customer is a series, an order an episode, a line item a page.
``pos`` of a listing is the crawl's own sequence number, the order key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriatim.functions import urls as U
from seriatim.operators import ordered, status
from seriatim.sources.tables import table

#: Rules for the hosts of ``pages``: priority, form, rule, host pattern, schemes, kind, path, query key, publisher.
FORMS = (
    (1, 1, "blog", "blog.%", "http,https", "series", "^/[a-z]+/[0-9]+/$", "", ""),
    (1, 2, "blog", "blog.%", "http,https", "episode", "^/[a-z]+/[0-9]+[.]html$", "", ""),
    (2, 1, "com", "%.example.com", "https", "series", "^/[a-z]+/[0-9]+$", "page", "Com House"),
    (2, 2, "com", "%.example.com", "https", "episode", "^/[a-z]+/[0-9]+([.]html)?/?$", "", "Com House"),
    (2, 3, "com", "%.example.com", "https", "tag", "^/[A-Za-z]+[,.]?$", "", "Com House"),
    (3, 1, "net", "%.example.net", "http,https", "episode", "^/[a-z]+/[0-9]+", "", "Net House"),
    (3, 2, "net", "%.example.net", "http,https", "tag", "^/[^/]+$", "", "Net House"),
    (4, 1, "www", "www.%", "https", "episode", "^/[a-z]+/[0-9]+", "", ""),
    (4, 2, "www", "www.%", "https", "tag", "^/[a-z]+$", "", ""),
)

_FORM_ROWS = ",\n    ".join(str(form) for form in FORMS)

SQL = {
    "page_host": "SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM pages",
    "site_rule": f"""
  SELECT f.priority, f.form, f.rule, h.host, f.schemes, f.kind, f.path_regex, f.query_key, f.publisher,
         CASE WHEN h.host LIKE 'm.%' OR h.host LIKE 'www.%' THEN upper(split_part(h.host, '.', 2)) END AS host_publisher
  FROM page_host h JOIN (VALUES
    {_FORM_ROWS}
  ) f(priority, form, rule, host_like, schemes, kind, path_regex, query_key, publisher) ON h.host LIKE f.host_like""",
    "listing": """
  SELECT o_custkey AS series_id, o_orderkey AS pos, o_orderkey AS episode_id,
         CASE WHEN o_orderpriority LIKE '1-%' THEN '番外編'
              ELSE '第' || (month(o_orderdate) * 100 + day(o_orderdate)) || '話' END AS label,
         CAST(o_orderdate AS DATE) AS listed, o_orderstatus <> 'P' AS open,
         o_orderpriority AS priority
  FROM orders""",
    "page_row": """
  SELECT l_orderkey AS episode_id, l_linenumber AS page_no, min(l_partkey * 100000 + l_suppkey) AS image
  FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "page_count": "SELECT episode_id, count(*) AS n_pages FROM page_row GROUP BY episode_id",
    "episode": """
  SELECT l.series_id, l.pos, l.episode_id, l.label, l.listed AS published, l.open, l.priority,
         coalesce(c.n_pages, 0) AS n_pages, l.open AND c.n_pages IS NOT NULL AS readable
  FROM listing l LEFT JOIN page_count c USING (episode_id)""",
    "landed": """
  SELECT l_orderkey AS episode_id, bool_or(l_shipdate < TIMESTAMP '1997-01-01') AS pages_there,
         bool_or(l_shipdate < TIMESTAMP '1996-07-01') AS archive_there FROM lineitem GROUP BY l_orderkey""",
    "result": """
  SELECT e.series_id, e.pos, e.episode_id, e.label, e.published, e.n_pages, e.readable,
         CASE WHEN coalesce(d.pages_there AND d.archive_there, false) THEN 'exists'
              WHEN NOT coalesce(d.pages_there, false) AND NOT e.readable THEN 'locked' ELSE 'saved' END AS status
  FROM episode e LEFT JOIN landed d USING (episode_id)""",
    "series": """
  SELECT c_custkey AS series_id, c_name AS title, c_mktsegment AS writer,
         'n' || c_nationkey || '.example.com' AS host, c_nationkey AS nation_id
  FROM customer""",
    "edge": """
  SELECT series_id, episode_id AS node,
         lag(episode_id) OVER w AS prev_node,
         CASE WHEN lead(episode_id) OVER w IS NOT NULL THEN lead(episode_id) OVER w
              WHEN priority LIKE '2-%' THEN min(episode_id) OVER (PARTITION BY series_id)
              WHEN priority LIKE '3-%' THEN -episode_id - 1 END AS next_node
  FROM listing WINDOW w AS (PARTITION BY series_id ORDER BY pos)""",
    "anchor": r"""
  SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS origin,
         unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href,
         unnest(range(1, len(regexp_extract_all(html, '<a href="([^"]*)">', 1)) + 1)) AS idx
  FROM pages""",
}

_NEEDS = {
    "site_rule": ("page_host",),
    "page_count": ("page_row",),
    "episode": ("listing", "page_count"),
    "edge": ("listing",),
    "result": ("episode", "landed"),
}


def _with_needs(names: tuple[str, ...]) -> list[str]:
    seen: list[str] = []
    for name in names:
        for needed in (*_with_needs(_NEEDS.get(name, ())), name):
            if needed not in seen:
                seen.append(needed)
    return seen


def sql(*views: str, body: str) -> str:
    """``body`` after the common table expressions of the views it names."""
    if not views:
        return body
    tables = ",\n".join(f"{name} AS ({SQL[name]})" for name in _with_needs(views))
    joined = body.lstrip()
    if joined.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {tables},\n{joined[15:]}"
    return f"WITH {tables},\n{joined[5:]}" if joined.startswith("WITH ") else f"WITH {tables}\n{body}"


def pages(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "pages", *(columns or ("page_id", "url", "html")))


def site_rule(spark: SparkSession, folder: str) -> DataFrame:
    hosts = pages(spark, folder, "url").select(U.host(F.col("url")).alias("host")).distinct()
    forms = F.array(
        *[
            F.struct(
                F.lit(priority).alias("priority"),
                F.lit(form).alias("form"),
                F.lit(rule).alias("rule"),
                F.lit(like).alias("host_like"),
                F.lit(schemes).alias("schemes"),
                F.lit(kind).alias("kind"),
                F.lit(path_regex).alias("path_regex"),
                F.lit(query_key).alias("query_key"),
                F.lit(publisher).alias("publisher"),
            )
            for priority, form, rule, like, schemes, kind, path_regex, query_key, publisher in FORMS
        ]
    )
    own = F.upper(F.split_part("host", F.lit("."), F.lit(2)))
    return (
        hosts.select("host", F.inline(forms))
        .where(F.like(F.col("host"), F.col("host_like")))
        .withColumn("schemes", F.split("schemes", ","))
        .withColumn("host_publisher", F.when(F.col("host").like("m.%") | F.col("host").like("www.%"), own))
        .drop("host_like")
    )


def listing(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    number = (F.month("o_orderdate") * 100 + F.dayofmonth("o_orderdate")).cast("string")
    return orders.select(
        F.col("o_custkey").alias("series_id"),
        F.col("o_orderkey").alias("pos"),
        F.col("o_orderkey").alias("episode_id"),
        F.when(F.col("o_orderpriority").like("1-%"), F.lit("番外編"))
        .otherwise(F.concat(F.lit("第"), number, F.lit("話")))
        .alias("label"),
        F.col("o_orderdate").cast("date").alias("listed"),
        (F.col("o_orderstatus") != "P").alias("open"),
        F.col("o_orderpriority").alias("priority"),
    )


def page_row(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (episode, page number): of the duplicates the smallest image id."""
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    image = F.col("l_partkey") * 100000 + F.col("l_suppkey")
    return lines.groupBy(
        F.col("l_orderkey").alias("episode_id"), F.col("l_linenumber").alias("page_no")
    ).agg(F.min(image).alias("image"))


def page_count(spark: SparkSession, folder: str) -> DataFrame:
    return page_row(spark, folder).groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_pages"))


def episode(spark: SparkSession, folder: str) -> DataFrame:
    counted = listing(spark, folder).join(page_count(spark, folder), "episode_id", "left")
    return counted.select(
        "series_id",
        "pos",
        "episode_id",
        "label",
        F.col("listed").alias("published"),
        "open",
        "priority",
        F.coalesce("n_pages", F.lit(0)).alias("n_pages"),
        (F.col("open") & F.col("n_pages").isNotNull()).alias("readable"),
    )


#: What counts as there already of an episode, its pages or its archive: a page shipped before this day.
_THERE = {"pages_there": "1997-01-01", "archive_there": "1996-07-01"}


def result(spark: SparkSession, folder: str) -> DataFrame:
    """Every episode with what a visit makes of it."""
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate")
    facts = lines.groupBy(F.col("l_orderkey").alias("episode_id")).agg(
        F.count_distinct("l_linenumber").alias("n_pages"),
        *[F.bool_or(F.col("l_shipdate") < F.lit(day).cast("timestamp_ntz")).alias(name) for name, day in _THERE.items()],
    )
    readable = F.col("open") & F.col("n_pages").isNotNull()
    there = status.result_status(status.known(F.col("pages_there")), status.known(F.col("archive_there")), readable)
    return (
        listing(spark, folder)
        .join(facts, "episode_id", "left")
        .select(
            "series_id",
            "pos",
            "episode_id",
            "label",
            F.col("listed").alias("published"),
            F.coalesce("n_pages", F.lit(0)).alias("n_pages"),
            readable.alias("readable"),
            there.alias("status"),
        )
    )


def series(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    host = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit(".example.com"))
    return customer.select(
        F.col("c_custkey").alias("series_id"),
        F.col("c_name").alias("title"),
        F.col("c_mktsegment").alias("writer"),
        host.alias("host"),
        F.col("c_nationkey").alias("nation_id"),
    )


def edge(spark: SparkSession, folder: str) -> DataFrame:
    """Previous and next links of every episode.

    The last episode of a series may link back to the first (a loop) or to an
    episode nobody landed (a dangling link), by its priority.
    """
    listed = listing(spark, folder).select("series_id", "pos", "episode_id", "priority")
    outputs = {
        "prev_node": ordered.before("episode_id"),
        "after": ordered.after("episode_id"),
        "_first": ordered.whole(F.min, "episode_id"),
    }
    linked = ordered.scan(listed, ["series_id"], "pos", outputs)
    after = (
        F.when(F.col("after").isNotNull(), F.col("after"))
        .when(F.col("priority").like("2-%"), F.col("_first"))
        .when(F.col("priority").like("3-%"), -F.col("episode_id") - 1)
    )
    return linked.select(
        "series_id", F.col("episode_id").alias("node"), "prev_node", after.alias("next_node")
    )
