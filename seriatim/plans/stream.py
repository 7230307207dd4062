"""Queries on streams (T1 to T3): the crawl's events as they land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriatim.operators import ordered, watch
from seriatim.plans.registry import Registry
from seriatim.sources.shared import new_path
from seriatim.sources.tables import table
from seriatim.streaming import batches, news, opened, patrol

REGISTRY = Registry()
query = REGISTRY.query


def _observed(events: DataFrame) -> DataFrame:
    """Events as observations: a user is an entry, the number in ``props`` an episode."""
    kind = F.col("event_type")
    status = F.when(kind == "error", F.lit("locked")).when(kind == "purchase", F.lit("saved")).otherwise(F.lit("exists"))
    return events.select(
        F.col("user_id").alias("entry"),
        F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("episode"),
        F.col("event_id").alias("seq"),
        status.alias("status"),
        "ts",
    )


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    return _observed(batches.landed_stream(spark, folder, "events", table(spark, folder, "events").schema))


_OBSERVED = """
WITH seen AS (SELECT user_id AS entry, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS episode, event_id AS seq,
    CASE event_type WHEN 'error' THEN 'locked' WHEN 'purchase' THEN 'saved' ELSE 'exists' END AS status FROM events),
latest AS (SELECT entry, episode, arg_max(status, seq) AS status, max(seq) AS seq, count(*) AS visits FROM seen GROUP BY entry, episode)
"""


@query("t1_patrolled_catalogue", _OBSERVED + "SELECT entry, episode, status, seq, visits FROM latest")
def t1_catalogue(spark, folder):
    """Every episode's latest status after all landed files were folded in."""
    path = new_path(spark, "patrol")
    patrol.run(_stream(spark, folder), f"{path}/table", f"{path}/checkpoint")
    return patrol.catalogue(spark, f"{path}/table")


@query(
    "t1_patrolled_watchlist",
    _OBSERVED
    + """SELECT entry, coalesce(min(episode) FILTER (WHERE status = 'locked'), max(episode)) AS episode
FROM latest GROUP BY entry HAVING NOT bool_and(status = 'locked')""",
)
def t1_watchlist(spark, folder):
    path = new_path(spark, "patrol")
    patrol.run(_stream(spark, folder), f"{path}/table", f"{path}/checkpoint")
    return patrol.watchlist(spark, f"{path}/table")


@query(
    "t1_patrol_rounds",
    _OBSERVED
    + """, stand AS (SELECT entry, CASE WHEN bool_and(status = 'locked') THEN min(episode)
    ELSE coalesce(min(episode) FILTER (WHERE status = 'locked'), max(episode)) END AS episode, NOT bool_and(status = 'locked') AS moved
  FROM latest WHERE entry IS NOT NULL AND episode IS NOT NULL GROUP BY entry)
SELECT entry AS pos, entry || '/' || episode AS url, CASE WHEN moved THEN 'work ' || entry ELSE '' END AS title FROM stand""",
)
def t1_rounds(spark, folder):
    """Every entry walked on from its first episode as statuses land, the list updated batch by batch."""
    name = F.concat_ws("/", "entry", "episode")
    listed = _observed(table(spark, folder, "events")).dropna(subset=["entry", "episode"]).select("entry", "episode").distinct()
    linked = ordered.scan(listed.withColumn("url", name), ["entry"], "episode", {"next_url": ordered.after("url")})
    watched = listed.groupBy("entry").agg(F.min("episode").alias("episode")).select(
        F.col("entry").alias("pos"), name.alias("url"), F.lit("").alias("title"), F.lit(False).alias("search"), F.lit(True).alias("chain")
    )
    visits = _stream(spark, folder).dropna(subset=["entry", "episode"])
    stream = visits.select(name.alias("url"), F.concat(F.lit("work "), "entry").alias("series_title"), "status", "seq")
    path = new_path(spark, "patrol")
    patrol.rounds(stream, watched, linked.select("url", "next_url"), f"{path}/table", f"{path}/checkpoint")
    return patrol.rounds_list(spark, f"{path}/table", watched.schema).select("pos", "url", "title")


@query("t2_new_items", _OBSERVED + "SELECT DISTINCT entry, episode FROM seen")
def t2(spark, folder):
    """Every (entry, episode) the first time it is seen."""
    path = new_path(spark, "news")
    stream = _stream(spark, folder).select("entry", "episode")
    news.first_seen(stream, stream.columns, f"{path}/table", f"{path}/checkpoint")
    return news.seen(spark, f"{path}/table", stream.schema)


_TURNED = (
    _OBSERVED
    + """SELECT entry, seq, status FROM (SELECT *, lag(status) OVER (PARTITION BY entry ORDER BY seq) AS was FROM seen)
WHERE was = 'locked' AND status = 'saved'"""
)


@query("t3_opened", _TURNED)
def t3(spark, folder):
    """Observations that found an entry open which was locked the time before."""
    observed = _observed(table(spark, folder, "events")).select("entry", "seq", "status")
    return watch.transitions(observed, "entry", "seq", "status", "locked", "saved")


@query("t3_opened_stream", _TURNED)
def t3_stream(spark, folder):
    path = new_path(spark, "opened")
    stream = _stream(spark, folder)
    opened.run(stream, "entry", "seq", "status", "locked", "saved", f"{path}/table", f"{path}/checkpoint")
    schema = _observed(table(spark, folder, "events")).select("entry", "seq", "status").schema
    return opened.found(spark, f"{path}/table", schema)
