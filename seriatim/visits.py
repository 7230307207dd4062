"""Whole visits: from URLs to what became of every episode, and from search pages to their links.

The tables a visit reads:

``rules``     the rule table of ``seriatim.operators.routing``
``listings``  ``series_url``, ``pos``, ``episode_url``
``edges``     ``url``, ``prev_url``, ``next_url``
``episodes``  ``url``, ``series_title``, ``episode_title``, ``status``
``pages``     ``page_id``, ``url``, ``html``
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriatim.functions import urls as U
from seriatim.operators import chain, links, ordered, routing
from seriatim.sources.shared import written


def find_rule(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """The rule that takes each URL and what the URL names."""
    return routing.route(urls, rules, url)


def series_urls(urls: DataFrame, listings: DataFrame, url: str = "url") -> DataFrame:
    """The episodes each series URL lists, each once, ``place`` from 1."""
    listed = urls.select(F.col(url).alias("series_url")).distinct().join(listings, "series_url")
    once = ordered.first_of_each(listed, ["series_url", "episode_url"], "pos")
    return ordered.number_rows(once, ["series_url"], "pos", "place", ties=["episode_url"]).drop("pos")


def visit(
    urls: DataFrame,
    rules: DataFrame,
    listings: DataFrame,
    edges: DataFrame,
    episodes: DataFrame,
    *,
    bulk: bool = False,
    back: bool = False,
    report: bool = False,
) -> DataFrame:
    """Every episode a visit to each URL reads, with what became of it.

    A series URL stands for the episodes it lists; an episode URL for itself
    and, with ``bulk``, the ones after it, with ``back`` the ones before it.
    URLs no rule takes and listed episodes without a record are left out, or
    with ``report`` come as rows of status ``unrouted`` and ``failed``, a series
    without a listing and an episode without a link record too. ``place`` is the
    reading order inside a visit.
    """
    routed = find_rule(urls.select("url").distinct(), rules)
    listed = series_urls(routed.where("kind = 'series'"), listings).select(
        F.col("series_url").alias("visit"), F.col("episode_url").alias("url"), "place"
    )
    seeds = routed.where("kind = 'episode'").select(F.col("url").alias("visit"))
    if back and bulk:
        walked = chain.both_ways(edges, seeds, "url", "prev_url", "next_url", "visit")
    elif bulk or back:
        walked = chain.walk(edges, seeds, "url", "next_url" if bulk else "prev_url", "visit")
        walked = walked.withColumn("depth", F.col("depth") if bulk else -F.col("depth"))
    else:
        walked = seeds.select("visit", F.col("visit").alias("url"), F.lit(0).cast("bigint").alias("depth"))
    reached = listed.unionByName(walked.withColumnRenamed("depth", "place"))
    if not report:
        return reached.join(episodes, "url")
    # What led nowhere stands for itself, at no place.
    asked = routed.select(F.col("url").alias("visit"), F.coalesce("kind", F.lit("")).alias("_kind"))
    nowhere = asked.join(reached.select("visit").distinct(), "visit", "left_anti")
    nowhere = nowhere.select("visit", F.col("visit").alias("url"), F.lit(None).cast("bigint").alias("place"), "_kind")
    known = episodes.withColumn("_known", F.lit(True))
    told = reached.withColumn("_kind", F.lit("episode")).unionByName(nowhere).join(known, "url", "left")
    lost = F.when(F.col("_kind") == "", F.lit("unrouted")).when(F.col("_known").isNull() | F.col("place").isNull(), F.lit("failed"))
    return told.withColumn("status", F.coalesce(lost, F.col("status"))).drop("_kind", "_known")


def search_again(watchlist: DataFrame, pages: DataFrame, rules: DataFrame, last: str, page: str = "url") -> DataFrame:
    """``search`` for the search entries of a watch list; ``last`` names its column for the end of open ranges."""
    templates = watchlist.where("search").select(F.col("url").alias("search"), F.col(last).alias("last"))
    return search(templates, pages, rules, page)


def search(templates: DataFrame, pages: DataFrame, rules: DataFrame, page: str = "url", only: str | None = None) -> DataFrame:
    """The links that numbered search pages newly offer, with the rule that takes each.

    ``templates`` has ``search`` (a URL, usually with a page range) and ``last``
    (where an open-ended range ends at the latest). A page that never landed
    has failed; of several landings of one page the first counts. Pages are
    told apart by ``page``, of which only the fragment is cut. ``only`` names the
    one rule whose links count.
    """
    expanded = links.expand_pages(templates.distinct(), "search", "last").select(
        "search", F.coalesce("page_no", F.lit(0)).alias("page_no"), "open_ended", U.drop_fragment(F.col("page_url")).alias("_page")
    )
    landed = pages.select(U.drop_fragment(F.col(page)).alias("_page"), "page_id")
    first = landed.groupBy("_page").agg(F.min("page_id").alias("page_id"))
    asked = written(
        expanded.join(first, "_page", "left").select(
            "search", "page_no", "open_ended", "page_id", F.col("page_id").isNull().alias("failed")
        ),
        "asked",
    )
    wanted = pages.join(asked.select("page_id").where("page_id IS NOT NULL").distinct(), "page_id", "left_semi")
    mine = rules if only is None else rules.where(F.col("rule") == only)
    taken = links.downloadable_links(wanted.drop(*({page} - {"url"})), mine).select("page_id", "pos", "link", "rule", "kind")
    found = asked.join(taken, "page_id").select("search", "page_no", "pos", "link", "rule", "kind")
    return links.paginate(asked, found, ["search"], "page_no", "failed", open_ended="open_ended", keep=["rule", "kind"])
