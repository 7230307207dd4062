"""Joins between pages, episodes, listings and works."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriatim.operators import chain, ordered


def as_of(
    pages: DataFrame, starts: DataFrame, group: Sequence[str], number: str, name: str, start: str
) -> DataFrame:
    """The start each page belongs to, as ``start``; null when there is none.

    A numbered page takes the greatest numbered start at or before it. A named
    page (null ``number``) takes only the start of the same ``name``. Numbered
    rows meet in one ordered pass, named ones in an equality join.
    """
    kind = starts.schema[start].dataType
    keys = [*group, number]
    numbered = pages.where(F.col(number).isNotNull()).withColumn(start, F.lit(None).cast(kind)).withColumn("_page", F.lit(1))
    marks = starts.where(F.col(number).isNotNull()).groupBy(*keys).agg(F.min(start).alias(start))
    both = numbered.unionByName(marks.withColumn("_page", F.lit(0)), allowMissingColumns=True)
    # Many pages may share a number: blocks are cut inside it, the row's own hash settling the order.
    both = ordered.range_blocks(both, group, [number, "_page", F.xxhash64(*pages.columns)])
    found = ordered.scan(both, group, number, {"_start": ordered.known_before(start)}, ties=["_page"]).where("_page = 1")
    found = found.withColumn(start, F.col("_start")).select(*pages.columns, start)
    names = starts.where(F.col(number).isNull()).groupBy(*group, name).agg(F.min(start).alias(start))
    named = pages.where(F.col(number).isNull()).join(names, [*group, name], "left").select(*pages.columns, start)
    return found.unionByName(named)


def filled_from_listing(
    episodes: DataFrame, listing: DataFrame, key: str, readable: str, fields: Sequence[str], always: Sequence[str] = ()
) -> DataFrame:
    """Episodes whose missing page record is made up from their series' listing.

    A readable episode keeps its own fields, a locked one takes the listing's;
    a field the listing lacks stays the episode's own. Fields in ``always`` are
    the listing's for every episode.
    """
    renamed = listing.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = episodes.join(renamed, key, "left")
    filled = {
        f: F.col(f"_{f}") if f in always else F.coalesce(F.when(~F.col(readable), F.col(f"_{f}")), F.col(f))
        for f in fields
    }
    return joined.withColumns(filled).drop(*[f"_{f}" for f in fields])


def first_kind(*lists: DataFrame, key: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per key from the first list that holds it; ``kind`` counts the lists from 0."""
    ranked = [held.select(*key, *keep).withColumn("kind", F.lit(n)) for n, held in enumerate(lists)]
    merged = ranked[0]
    for more in ranked[1:]:
        merged = merged.unionByName(more)
    best = F.min(F.struct("kind", *keep)).alias("_best")
    return merged.groupBy(*key).agg(best).select(*key, "_best.*")


def dated_by_upload(episodes: DataFrame, uploads: DataFrame, key: str, published: str, uploaded: str, n_pages: str):
    """Undated episodes with pages take the upload day of their first page."""
    told = episodes.join(uploads.select(key, uploaded), key, "left")
    late = F.when(F.col(n_pages) > 0, F.col(uploaded))
    return told.withColumn(published, F.coalesce(F.col(published), late)).drop(uploaded)


def list_holding(lists: Column, key: Column) -> Column:
    """Of several lists on a page the first that holds the key; an empty one when none does."""
    holding = F.filter(lists, lambda held: F.array_contains(held, key))
    return F.coalesce(F.get(holding, F.lit(0)), F.array().cast("array<string>"))


def merged_runs(*runs: DataFrame, group: Sequence[str], item: str, order: str) -> DataFrame:
    """Runs of one listing that overlap, made one: each item once, ``place`` by its order number."""
    merged = runs[0]
    for more in runs[1:]:
        merged = merged.unionByName(more)
    once = merged.groupBy(*group, item).agg(F.min(order).alias(order))
    return ordered.number_rows(once, group, order, "place", ties=[item])


def preferred_or_else(preferred: DataFrame, fallback: DataFrame, group: Sequence[str]) -> DataFrame:
    """A group's preferred rows; the fallback's only where it has none of them."""
    without = fallback.join(preferred.select(*group).distinct(), list(group), "left_anti")
    return preferred.unionByName(without)


def prepend_older(
    listing: DataFrame, edges: DataFrame, series: str, pos: str, item: str, node: str, prev: str, limit: int
) -> DataFrame:
    """A listing cut at ``limit`` entries, with the older episodes its previous links lead to before it.

    ``place`` counts up from the oldest; older ones walk back until they meet
    a listed item or the chain ends.
    """
    full = listing.groupBy(series).agg(F.count(F.lit(1)).alias("_n"), F.min_by(item, pos).alias("_seed"))
    seeds = full.where(F.col("_n") >= limit).select(series, "_seed")
    walked = chain.walk(edges.select(node, prev), seeds, node, prev, "_seed").where("depth > 0")
    met = walked.join(listing.select(series, F.col(item).alias(node)), [series, node])
    stop = met.groupBy(series).agg(F.min("depth").alias("_stop"))
    older = (
        walked.join(stop, series, "left")
        .where(F.col("_stop").isNull() | (F.col("depth") < F.col("_stop")))
        .select(series, F.col(node).alias(item), (-F.col("depth")).alias("_key"))
    )
    listed = ordered.number_rows(listing, [series], pos, "_key").select(series, item, "_key")
    return ordered.number_rows(older.unionByName(listed), [series], "_key", "place").drop("_key")


def episodes_of_authors(works: DataFrame, episodes: DataFrame, author: str, work: str, work_pos: str, pos: str):
    """An author's works expanded to their episodes, works in site order, ``place`` over all of them."""
    once = ordered.first_of_each(works, [author, work], work_pos)
    joined = once.join(episodes, work)
    cut = ordered.range_blocks(joined, [author], [work_pos, work, pos])
    return ordered.number_rows(cut, [author], work_pos, "place", ties=[work, pos])


def saved_already(episodes: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    return episodes.join(saved.select(key).distinct(), key, "left_semi")


def not_saved_yet(episodes: DataFrame, saved: DataFrame, key: str, *, overwrite: bool = False, by_key: bool = False) -> DataFrame:
    """The episodes still to be saved, all of them with ``overwrite``.

    ``by_key``: ``saved`` is a table that ``sinks.write_saved`` made. It holds
    each key once and lies by it, so it is joined as it lies.
    """
    if overwrite:
        return episodes
    known = saved.select(key) if by_key else saved.select(key).distinct()
    return episodes.join(known.hint("merge") if by_key else known, key, "left_anti")


def listing_by_frame(readers: DataFrame, frame_links: DataFrame, listings: DataFrame, frame: str, link: str, pos: str):
    """A reader page's work listing, found through the frame it names.

    The frame's first link is the work; any missing hop leaves nulls, the
    reader page stays. ``frame_links`` holds links of work shape only.
    """
    works = ordered.first_of_each(frame_links, [frame], pos, [link]).select(frame, link)
    return readers.join(works, frame, "left").join(listings, link, "left")


def merged_links(record: Column, listed: Column, *, listing_first: bool = False, only_without_pages: Column | None = None):
    """A previous or next link told twice: by the page record and by the listing.

    The first side that names one wins; ``only_without_pages`` lets the listing
    speak only where the episode has no pages.
    """
    if only_without_pages is not None:
        return F.coalesce(record, F.when(only_without_pages == 0, listed))
    return F.coalesce(listed, record) if listing_first else F.coalesce(record, listed)


def swapped(before: Column, after: Column, newest_first: Column) -> tuple[Column, Column]:
    """Printed neighbours as reading-order neighbours: swapped in a newest-first listing."""
    return (
        F.when(newest_first, after).otherwise(before),
        F.when(newest_first, before).otherwise(after),
    )
