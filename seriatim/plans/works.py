"""Queries on status, summaries, the watch list and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriatim.functions import dates as D
from seriatim.functions import urls as U
from seriatim.operators import audit, ordered, routing, status, watch
from seriatim.plans import views
from seriatim.plans.registry import Registry
from seriatim.plans.views import sql
from seriatim.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.query


@query(
    "a1_readable",
    """
SELECT o_orderkey AS episode_id, CASE WHEN o_orderpriority < '3' THEN o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_totalprice > 250000)
  WHEN o_orderpriority < '5' THEN NOT (o_orderstatus = 'P' OR o_totalprice > 400000) ELSE o_orderstatus <> 'P' END AS readable FROM orders""",
)
def a1(spark, folder):
    """Each rule's own predicate; a flag that is missing counts as no."""
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    state, price = F.col("o_orderstatus"), F.col("o_totalprice")
    bought = F.when((state == "O") & (price > 250000), F.lit(True))
    left = F.when(price > 400000, F.lit(2))
    by_flags = status.open_or_bought(state == "F", bought)
    by_price = status.not_for_sale(F.when(state == "P", F.lit(100)), F.lit(None).cast("boolean"), left)
    rule = F.when(F.col("o_orderpriority") < "3", F.lit("flags")).when(F.col("o_orderpriority") < "5", F.lit("price"))
    rule = F.coalesce(rule, F.lit("link"))
    readable = status.readable_by_rule(rule, {"flags": by_flags, "price": by_price}, otherwise=state != "P")
    return orders.select(F.col("o_orderkey").alias("episode_id"), readable.alias("readable"))


@query("a2_result_status", sql("result", body="SELECT episode_id, status FROM result"))
def a2(spark, folder):
    return views.result(spark, folder).select("episode_id", "status")


_SUMMARY = """
WITH one AS (SELECT r.series_id, year(r.published) AS year, count(*) FILTER (WHERE status = 'saved') AS saved, count(*) FILTER (WHERE status = 'exists') AS "exists",
    count(*) FILTER (WHERE status = 'locked') AS locked, count(*) AS episodes, min(s.host || '/' || s.title) AS folder,
    min(r.label) AS label FROM result r JOIN series s USING (series_id) GROUP BY r.series_id, year(r.published)),
led AS (SELECT *, CASE WHEN saved > 0 THEN 'saved' WHEN "exists" > 0 THEN 'exists' ELSE 'locked' END AS lead FROM one)
SELECT series_id, year, saved, "exists", locked, episodes, lead, CASE lead WHEN 'locked' THEN 'warning' ELSE 'info' END AS level,
  CASE WHEN episodes = 1 AND lead = 'locked' THEN 'skip: \'\'' || label || '\'\' needs a purchase, a wait or a login.'
       WHEN episodes = 1 THEN replace(lead, 'exists', 'skipped') || ': ' || folder || '/' || label
       ELSE replace(lead, 'exists', 'skipped') || ': ' || folder || ' (' ||
         CASE lead WHEN 'saved' THEN saved WHEN 'exists' THEN "exists" ELSE locked END || ' episodes' ||
         CASE WHEN lead = 'saved' AND "exists" > 0 THEN ', ' || "exists" || ' skipped' ELSE '' END ||
         CASE WHEN lead <> 'locked' AND locked > 0 THEN ', ' || locked || ' locked' ELSE '' END || ')' END AS message
FROM led"""


def _yearly(spark, folder):
    """Results by work, a work being a series' episodes of one year."""
    return views.result(spark, folder).withColumn("year", F.year("published"))


@query("a3_work_summary", sql("result", "series", body=_SUMMARY))
def a3(spark, folder):
    results = _yearly(spark, folder).select("series_id", "year", "label", "status")
    works = views.series(spark, folder).select("series_id", "host", "title")
    folders = works.select("series_id", F.concat_ws("/", "host", "title").alias("folder"))
    return status.summarise(results, folders, ["series_id", "year"], "label", "folder", "status")


@query(
    "a4_nothing_readable",
    sql(
        "result",
        body="""
SELECT series_id, year(listed) AS year FROM listing GROUP BY ALL
EXCEPT SELECT series_id, year(published) FROM result WHERE n_pages > 0 AND status <> 'locked'""",
    ),
)
def a4(spark, folder):
    """Works whose every episode with pages is locked, or that have none."""
    works = views.listing(spark, folder).select("series_id", F.year("listed").alias("year")).distinct()
    results = _yearly(spark, folder).where("n_pages > 0").select("series_id", "year", "status")
    return status.nothing_readable(works, results, ["series_id", "year"], "status")


@query(
    "a5_next_entry",
    sql(
        "result",
        body="""
SELECT series_id, coalesce(min(episode_id) FILTER (WHERE status = 'locked'), max(episode_id)) AS episode_id, arg_max(label, pos) AS label
FROM result GROUP BY series_id HAVING NOT bool_and(status = 'locked')""",
    ),
)
def a5(spark, folder):
    """Where a walk over each whole series would leave its watch-list entry."""
    visited = views.result(spark, folder).select("series_id", "pos", "episode_id", "label", "status")
    return watch.next_entries(visited, "series_id", "pos", "episode_id", "label", "status")


_WATCHED = """
WITH watched AS (SELECT c_custkey AS pos, 'w' || c_custkey AS url, c_name AS title, c_mktsegment = 'HOUSEHOLD' AS search FROM customer
  UNION ALL SELECT 10000000 + s_suppkey, 'w' || s_suppkey, s_name, false FROM supplier),
new AS (SELECT o_orderkey AS seq, CASE WHEN o_orderpriority < '2' THEN 'w' || o_custkey ELSE 'e' || o_orderkey END AS url,
    CASE WHEN o_orderpriority < '2' THEN NULL WHEN o_orderpriority < '3' THEN 'x' || o_orderkey ELSE 'w' || o_custkey END AS replacing,
    CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'title ' || o_orderkey END AS title, o_orderpriority > '5' AS search FROM orders),
aim AS (SELECT n.*, (SELECT min(pos) FROM watched w WHERE w.url = n.url OR w.url = n.replacing) AS target FROM new n),
last AS (SELECT * EXCLUDE (title), (SELECT arg_max(b.title, b.seq) FROM aim b WHERE b.target = a.target AND b.title <> '') AS title
  FROM aim a WHERE target IS NOT NULL QUALIFY row_number() OVER (PARTITION BY target ORDER BY seq DESC) = 1)
"""


@query(
    "a6_watchlist_upsert",
    _WATCHED
    + """SELECT w.pos, coalesce(l.url, w.url) AS url, coalesce(nullif(l.title, ''), w.title) AS title, coalesce(l.search, w.search) AS search
FROM watched w LEFT JOIN last l ON l.target = w.pos
UNION ALL SELECT (SELECT max(pos) FROM watched) + row_number() OVER (ORDER BY seq), url, title, search FROM aim WHERE target IS NULL""",
)
def a6(spark, folder):
    """Every order as an update to a watch list of customers and suppliers."""
    customer = table(spark, folder, "customer", "c_custkey", "c_name", "c_mktsegment")
    supplier = table(spark, folder, "supplier", "s_suppkey", "s_name")

    def tag(letter, column):
        return F.concat(F.lit(letter), F.col(column).cast("string"))

    watched = customer.select(
        F.col("c_custkey").alias("pos"),
        tag("w", "c_custkey").alias("url"),
        F.col("c_name").alias("title"),
        (F.col("c_mktsegment") == "HOUSEHOLD").alias("search"),
    ).unionByName(
        supplier.select(
            (F.col("s_suppkey") + 10_000_000).alias("pos"),
            tag("w", "s_suppkey").alias("url"),
            F.col("s_name").alias("title"),
            F.lit(False).alias("search"),
        )
    )
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    updates = orders.select(
        F.col("o_orderkey").alias("seq"),
        F.when(rank == 1, tag("w", "o_custkey")).otherwise(tag("e", "o_orderkey")).alias("url"),
        F.when(rank == 2, tag("x", "o_orderkey")).when(rank > 2, tag("w", "o_custkey")).alias("replacing"),
        F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(tag("title ", "o_orderkey")).alias("title"),
        (rank == 5).alias("search"),
    )
    return watch.upsert(watched, updates)


@query(
    "a6_watchlist_moves",
    """
WITH watched AS (SELECT c_custkey AS pos, 'w' || c_custkey AS url, c_name AS title, false AS search FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'),
new AS (SELECT o_custkey, o_orderkey AS seq, 'e' || o_orderkey AS url, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'title ' || o_orderkey END AS title,
    o_orderpriority > '5' AS search FROM orders),
stand AS (SELECT o_custkey, min(seq) AS first, arg_max(url, seq) AS url, arg_max(title, seq) FILTER (WHERE title <> '') AS title,
    arg_max(search, seq) AS search FROM new GROUP BY o_custkey)
SELECT w.pos, coalesce(s.url, w.url) AS url, coalesce(s.title, w.title) AS title, coalesce(s.search, w.search) AS search
FROM watched w LEFT JOIN stand s ON s.o_custkey = w.pos
UNION ALL SELECT (SELECT max(pos) FROM watched) + row_number() OVER (ORDER BY first), url, coalesce(title, ''), search
FROM stand WHERE NOT EXISTS (SELECT 1 FROM watched WHERE pos = o_custkey)""",
)
def a6_moves(spark, folder):
    """Entries that move on with every order of their customer; customers not on the list are appended once."""
    customer = table(spark, folder, "customer", "c_custkey", "c_name", "c_mktsegment")
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")

    def tag(letter, column):
        return F.concat(F.lit(letter), F.col(column).cast("string"))

    watched = customer.where("c_mktsegment <> 'HOUSEHOLD'").select(
        F.col("c_custkey").alias("pos"), tag("w", "c_custkey").alias("url"), F.col("c_name").alias("title"), F.lit(False).alias("search")
    )
    moves = ordered.scan(orders, ["o_custkey"], "o_orderkey", {"before": ordered.before("o_orderkey")})
    updates = moves.select(
        F.col("o_orderkey").alias("seq"),
        tag("e", "o_orderkey").alias("url"),
        F.coalesce(tag("e", "before"), tag("w", "o_custkey")).alias("replacing"),
        F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(tag("title ", "o_orderkey")).alias("title"),
        (F.substring("o_orderpriority", 1, 1) == "5").alias("search"),
    )
    return watch.upsert(watched, updates)


@query(
    "a7_patrol",
    sql(
        "result",
        body="""
WITH entry AS (SELECT c.c_custkey AS pos, c_mktsegment AS kind, c_name AS name, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS first FROM customer c),
before AS (SELECT pos, CASE WHEN kind = 'HOUSEHOLD' THEN 'search/' || pos WHEN kind = 'MACHINERY' THEN 'series/' || pos
    ELSE 'episode/' || coalesce(first, -1 - pos) END AS url, '' AS title, kind = 'HOUSEHOLD' AS search, kind, name FROM entry),
stand AS (SELECT series_id, coalesce(min(episode_id) FILTER (WHERE status = 'locked'), max(episode_id)) AS at
  FROM result GROUP BY series_id HAVING NOT bool_and(status = 'locked'))
SELECT b.pos, CASE WHEN moved THEN 'episode/' || s.at ELSE b.url END AS url, CASE WHEN moved OR (kind = 'MACHINERY' AND s.at IS NOT NULL) THEN b.name ELSE b.title END AS title, b.search
FROM (SELECT *, kind NOT IN ('HOUSEHOLD', 'MACHINERY') AS walked FROM before) b LEFT JOIN stand s ON s.series_id = b.pos,
LATERAL (SELECT walked AND s.at IS NOT NULL AS moved)""",
    ),
)
def a7(spark, folder):
    """One patrol over a watch list with an entry per customer: chains, series, search pages, dead entries."""

    def url_of(kind, column):
        return F.concat(F.lit(kind + "/"), column.cast("string"))

    first = table(spark, folder, "orders", "o_custkey", "o_orderkey").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    customer = table(spark, folder, "customer", "c_custkey", "c_mktsegment")
    segment, pos = F.col("c_mktsegment"), F.col("c_custkey")
    watched = customer.join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        pos.alias("pos"),
        F.when(segment == "HOUSEHOLD", url_of("search", pos))
        .when(segment == "MACHINERY", url_of("series", pos))
        .otherwise(url_of("episode", F.coalesce("first", -1 - pos)))
        .alias("url"),
        F.lit("").alias("title"),
        (segment == "HOUSEHOLD").alias("search"),
        (~segment.isin("HOUSEHOLD", "MACHINERY")).alias("chain"),
    )
    edges = views.edge(spark, folder).select(
        url_of("episode", F.col("node")).alias("url"), url_of("episode", F.col("next_node")).alias("next_url")
    )
    titles = views.series(spark, folder).select("series_id", F.col("title").alias("series_title"))
    episodes = views.result(spark, folder).join(titles, "series_id").select(
        url_of("episode", F.col("episode_id")).alias("url"), "series_title", "status"
    )
    listings = views.listing(spark, folder).select(
        url_of("series", F.col("series_id")).alias("series_url"), "pos", url_of("episode", F.col("episode_id")).alias("episode_url")
    )
    return watch.patrol(watched, edges, episodes, listings)


@query(
    "a8_inventory",
    sql("site_rule", body="SELECT priority, rule, count(DISTINCT host) AS hosts, count(DISTINCT form) AS forms, min(host) AS first_host FROM site_rule GROUP BY priority, rule"),
)
def a8(spark, folder):
    return audit.inventory(views.site_rule(spark, folder))


@query(
    "a8_inventory_forms",
    sql("site_rule", body="SELECT DISTINCT priority, rule, lower(host) AS host, form, kind FROM site_rule"),
)
def a8_forms(spark, folder):
    """The whole inventory: every host of every rule with the forms it takes."""
    return audit.inventory_forms(views.site_rule(spark, folder))


@query(
    "a9_availability",
    sql(
        "episode",
        body="""
SELECT episode_id, CASE WHEN priority LIKE '5-%' THEN 0 ELSE n_pages END AS n_pages,
  CASE WHEN priority LIKE '3-%' THEN published END AS ends FROM episode WHERE priority NOT LIKE '1-%'""",
    ),
)
def a9(spark, folder):
    """Expired episodes keep their record without pages; hidden ones are left out; an end date is read where given."""
    priority = F.col("priority")
    notice = F.when(priority.like("5-%"), F.lit("お知らせ：公開を終了しました。")).when(priority.like("2-%"), F.lit("更新"))
    ends = F.when(priority.like("3-%"), F.concat(F.date_format("published", "yyyy年M月d日"), F.lit("まで")))
    told = views.episode(spark, folder).where(~priority.like("1-%"))
    return told.select(
        "episode_id",
        status.available(F.col("n_pages"), notice, "公開を終了").alias("n_pages"),
        D.japan_day(ends).alias("ends"),
    )


@query(
    "a10_first_known",
    """
SELECT o_custkey AS series_id, coalesce(arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus <> 'P'), '') AS title,
  coalesce(arg_min(o_orderstatus, o_orderkey) FILTER (WHERE o_totalprice > 400000), '') AS writer FROM orders GROUP BY o_custkey""",
)
def a10(spark, folder):
    orders = table(spark, folder, "orders", "o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    pages = orders.select(
        F.col("o_custkey").alias("series_id"),
        F.col("o_orderkey").alias("page_no"),
        F.when(F.col("o_orderstatus") == "P", F.lit(" ")).otherwise(F.col("o_orderpriority")).alias("title"),
        F.when(F.col("o_totalprice") > 400000, F.col("o_orderstatus")).alias("writer"),
    )
    return status.first_known(pages, ["series_id"], ["page_no"], ["title", "writer"])


@query(
    "v1_unknown_keys",
    sql("site_rule", body="SELECT host FROM page_host WHERE host NOT IN (SELECT host FROM site_rule)"),
)
def v1(spark, folder):
    """Hosts of the crawl that no rule reads."""
    used = views.pages(spark, folder, "url").select(U.host(F.col("url")).alias("host"))
    return audit.unknown_keys(used, views.site_rule(spark, folder).select("host"), "host")


_WORKS = "SELECT page_id AS pos, 'https://' || regexp_extract(url, '^[a-z]+://([^/]*/[a-z]+)/', 1) AS url FROM pages"


@query(
    "v2_listed_again",
    f"SELECT pos, url FROM ({_WORKS}) QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) > 1",
)
def v2(spark, folder):
    work = F.concat(F.lit("https://"), F.regexp_extract("url", "^[a-z]+://([^/]*/[a-z]+)/", 1))
    watched = views.pages(spark, folder, "page_id", "url").select(F.col("page_id").alias("pos"), work.alias("url"))
    return audit.listed_again(watched, "url", "pos")


@query(
    "v3_unroutable",
    sql(
        "site_rule",
        body=r"""
SELECT page_id AS pos, url FROM pages p WHERE url NOT LIKE '%/fr/%' AND NOT EXISTS (SELECT 1 FROM site_rule r
  WHERE r.host = lower(regexp_extract(p.url, '^[a-z]+://([^/?#]*)', 1)) AND list_contains(string_split(r.schemes, ','), regexp_extract(p.url, '^([a-z]+):', 1))
    AND regexp_matches(regexp_extract(p.url, '^[a-z]+://[^/?#]*([^?#]*)', 1), r.path_regex)
    AND (r.query_key = '' OR regexp_matches(p.url, '[?&]' || r.query_key || '=')))""",
    ),
)
def v3(spark, folder):
    """Watch-list entries no rule takes; French pages are search pages and need none."""
    watched = views.pages(spark, folder, "page_id", "url").select(
        F.col("page_id").alias("pos"), "url", F.col("url").like("%/fr/%").alias("search")
    )
    return audit.unroutable(watched, views.site_rule(spark, folder), "url", "search").drop("search")


@query(
    "v4_registry_gaps",
    sql(
        "site_rule",
        body=r"""
WITH own AS (SELECT DISTINCT host FROM site_rule), house AS (SELECT DISTINCT host, CASE WHEN host LIKE 'blog.%' THEN '' ELSE 'house' END AS publisher FROM page_host),
proven AS (SELECT DISTINCT r.host FROM pages p JOIN site_rule r ON r.host = lower(regexp_extract(p.url, '^[a-z]+://([^/?#]*)', 1))
  WHERE list_contains(string_split(r.schemes, ','), regexp_extract(p.url, '^([a-z]+):', 1))
    AND regexp_matches(regexp_extract(p.url, '^[a-z]+://[^/?#]*([^?#]*)', 1), r.path_regex)
    AND (r.query_key = '' OR regexp_matches(p.url, '[?&]' || r.query_key || '=')))
SELECT host, 'no publisher' AS problem FROM own WHERE host NOT IN (SELECT host FROM house WHERE publisher <> '')
UNION ALL SELECT host, 'unknown host' FROM house WHERE host NOT IN (SELECT host FROM own)
UNION ALL SELECT host, 'no sample routed' FROM own WHERE host NOT IN (SELECT host FROM proven)""",
    ),
)
def v4(spark, folder):
    urls = views.pages(spark, folder, "url")
    hosts = urls.select(U.host(F.col("url")).alias("host")).distinct()
    house = F.when(F.col("host").like("blog.%"), F.lit("")).otherwise(F.lit("house"))
    return audit.registry_gaps(views.site_rule(spark, folder), hosts.withColumn("publisher", house), urls)


@query(
    "v5_permutation",
    """
WITH digits AS (SELECT o_orderkey AS episode_id, list_transform(string_split(CAST(o_orderkey AS VARCHAR), ''), lambda d: CAST(d AS INT)) AS d FROM orders)
SELECT episode_id, list_sort(d) = CAST(range(0, len(d)) AS INT[]) AS valid FROM digits""",
)
def v5(spark, folder):
    """Whether the digits of an episode number are 0..n-1 in some order."""
    digits = F.transform(F.split(F.col("o_orderkey").cast("string"), ""), lambda d: d.cast("int"))
    orders = table(spark, folder, "orders", "o_orderkey")
    return orders.select(F.col("o_orderkey").alias("episode_id"), audit.is_permutation(digits).alias("valid"))


@query(
    "x1_registered_rules",
    sql(
        "site_rule",
        body=r"""
WITH part AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^([a-z]+):', 1) AS scheme,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, url FROM pages),
own AS (SELECT p.page_id, min(r.priority * 100 + r.form) AS best, arg_min(r.rule, r.priority * 100 + r.form) AS rule FROM part p JOIN site_rule r USING (host)
  WHERE list_contains(string_split(r.schemes, ','), p.scheme) AND regexp_matches(p.path, r.path_regex)
    AND (r.query_key = '' OR regexp_matches(p.url, '[?&]' || r.query_key || '=')) GROUP BY p.page_id)
SELECT p.page_id, coalesce(o.rule, CASE WHEN p.host LIKE '%.org' THEN 'org' END) AS rule FROM part p LEFT JOIN own o USING (page_id)""",
    ),
)
def x1(spark, folder):
    """A user's own rule, rows added to the rule table, takes what was unrouted before."""
    hosts = views.pages(spark, folder, "url").select(U.host(F.col("url")).alias("host")).distinct()
    more = hosts.where(F.col("host").like("%.org")).select(
        F.lit(9).alias("priority"),
        F.lit(1).alias("form"),
        F.lit("org").alias("rule"),
        "host",
        F.array(F.lit("http"), F.lit("https")).alias("schemes"),
        F.lit("episode").alias("kind"),
        F.lit("^/").alias("path_regex"),
        F.lit("").alias("query_key"),
        F.lit("Org House").alias("publisher"),
        F.lit(None).cast("string").alias("host_publisher"),
    )
    rules = routing.register_rules(views.site_rule(spark, folder), more)
    return routing.route(views.pages(spark, folder, "page_id", "url"), rules).select("page_id", "rule")


@query(
    "x1_rules_of_forms",
    r"""
WITH part AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, '&' || regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS query FROM pages),
kind AS (SELECT page_id, url, CASE WHEN NOT host LIKE '%.com' THEN NULL WHEN regexp_matches(path, '^/[^/]+/[^/]+[.]html/?$') THEN 'article'
    WHEN NOT regexp_matches(path, '^/[^/]+/[^/]+/?$') THEN NULL WHEN regexp_matches(query, '&page=[^&]') THEN 'part' ELSE 'work' END AS kind FROM part)
SELECT page_id, url, CASE WHEN kind IS NOT NULL THEN 'com' END AS rule, kind FROM kind""",
)
def x1_forms(spark, folder):
    """Pages routed with rules written as URL forms, three for every host under .com."""
    pages = views.pages(spark, folder, "page_id", "url")
    hosts = pages.select(U.host(F.col("url")).alias("host")).where(F.col("host").like("%.com")).distinct()
    spelt = {"article": "/<lang>/<id>.html", "part": "/<lang>/<id>?page=<n>", "work": "/<lang>/<id>"}
    forms = F.array(
        *[
            F.struct(F.lit(n).alias("form"), F.lit(kind).alias("kind"), F.lit(path).alias("path"))
            for n, (kind, path) in enumerate(spelt.items(), 1)
        ]
    )
    table_ = hosts.select("host", F.inline(forms)).select(
        F.lit(1).alias("priority"),
        "form",
        F.lit("com").alias("rule"),
        "kind",
        F.concat(F.lit("https://"), "host", "path").alias("url_form"),
        F.lit("Com House").alias("publisher"),
        F.lit(None).cast("string").alias("host_publisher"),
    )
    return routing.route(pages, routing.rules_of_forms(table_))
