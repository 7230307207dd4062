"""Catalogue tables out: episode records, page manifests, archive descriptors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriatim.functions.text import path_segment
from seriatim.operators import ordered


def write_episodes(episodes: DataFrame, path: str, host: str = "host") -> None:
    """Episode records as JSON, one folder per host, nulls written, dates as ISO text.

    Rows of a host are brought together first, so a host has a file or a few,
    not one from every task. Spark sizes the parts at run time: small hosts share
    a task, one with a third of all episodes is split over many.
    """
    episodes.hint("rebalance", host).write.partitionBy(host).option("ignoreNullFields", "false").json(path)


def write_saved(saved: DataFrame, name: str, path: str, key: str, buckets: int = 64) -> DataFrame:
    """What is saved, each key once, as a table that lies by key: ``buckets`` parts, sorted inside.

    Joins on the key read it as it lies, so only the other side is shuffled: a
    day's new episodes, not the whole catalogue. ``name`` is the table's in the
    session's catalogue, ``path`` a folder all executors reach.
    """
    kept = saved.select(key).where(F.col(key).isNotNull()).distinct().repartition(buckets, key)
    kept.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return saved.sparkSession.table(name)


def file_name(index: Column, count: Column, extension: str = "jpg") -> Column:
    """A page's file name: its index from 0, as wide as the page count."""
    text, width = index.cast("string"), F.length(count.cast("string"))
    return F.concat(F.lpad(text, F.greatest(width, F.length(text)), F.lit("0")), F.lit(f".{extension}"))


def page_manifest(
    pages: DataFrame, episode: str, pos: str, *, ties: Sequence[str] = (), only_first: bool = False
) -> DataFrame:
    """Pages with ``page_index`` (from 0, reading order), the episode's ``page_count`` and their ``file_name``.

    ``only_first`` keeps one page per episode, which then is the whole count.
    """
    if only_first:
        rest = [c for c in pages.columns if c not in (episode, pos)]
        held = ordered.first_of_each(pages, [episode], pos, [*ties, *[c for c in rest if c not in ties]], ties=ties)
        numbered = held.withColumn("page_index", F.lit(0).cast("bigint")).withColumn("page_count", F.lit(1).cast("bigint"))
    else:
        outputs = {"_place": ordered.place(), "page_count": ordered.size()}
        placed = ordered.scan(pages, [episode], pos, outputs, ties=ties)
        numbered = placed.withColumn("page_index", F.col("_place") - 1).drop("_place")
    return numbered.withColumn("file_name", file_name(F.col("page_index"), F.col("page_count")))


def episode_folder(host: Column, rule: Column, series_title: Column, episode_title: Column) -> Column:
    """``site/series/episode``, the site being the host or, without one, the rule's name."""
    site = F.coalesce(F.nullif(host, F.lit("")), rule)
    return F.concat_ws("/", site, path_segment(series_title), path_segment(episode_title))


def archive_descriptors(episodes: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """What an archive says of its episode: titles, number, people, date parts, web, page count."""
    return episodes.join(counts.select(key, "page_count"), key).select(
        key,
        "title",
        "series",
        "number",
        "writer",
        "publisher",
        F.year("published").alias("year"),
        F.month("published").alias("month"),
        F.dayofmonth("published").alias("day"),
        F.col("url").alias("web"),
        F.lit("yes").alias("manga"),
        F.lit("ja").alias("language"),
        "page_count",
    )
