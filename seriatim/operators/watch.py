"""The watch list: what to remember of each work, and keeping the list current."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriatim.operators import chain, ordered, ranking
from seriatim.operators.ranking import Ranks
from seriatim.sources.shared import counted, written


def next_entries(visited: DataFrame, entry: str, depth: str, url: str, title: str, state: str) -> DataFrame:
    """Where each walked entry stands now: its first locked episode, else the last one reached.

    One row per entry with anything but locked results; ``url`` and ``title``
    (of the last episode visited).
    """
    locked = F.col(state) == "locked"
    return (
        visited.groupBy(entry)
        .agg(
            F.min_by(url, F.when(locked, F.col(depth))).alias("_pending"),
            F.max_by(url, depth).alias("_last"),
            F.max_by(title, depth).alias(title),
            F.every(locked).alias("_stuck"),
        )
        .where(~F.col("_stuck"))
        .select(entry, F.coalesce("_pending", "_last").alias(url), title)
    )


def upsert(watchlist: DataFrame, updates: DataFrame) -> DataFrame:
    """The watch list with updates applied: ``pos``, ``url``, ``title``, ``search``.

    ``updates`` has ``seq``, ``url``, ``replacing`` (the entry's former url or
    null), ``title``, ``search``. An update changes the first entry the list
    held under its new or its former url; where it held none, the update goes on
    from the last one before it that gave either url, and so changes what that
    one changed or appended. What is left is appended in order. Of several
    updates for one entry the last by ``seq`` counts, and for the title the
    last that has one.
    """
    changes, appended = resolved(watchlist, updates)
    return changed(watchlist.select("pos", "url", "title", "search"), changes).unionByName(appended)


def changed(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries with their changes, other columns as they were."""
    told = rows.join(changes, "pos", "left")
    new = {
        "url": F.coalesce(F.col("_new.url"), F.col("url")),
        "title": F.coalesce("_title", "title"),
        "search": F.coalesce(F.col("_new.search"), F.col("search")),
    }
    return told.select(*(new[c].alias(c) if c in new else F.col(c) for c in rows.columns))


def resolved(watchlist: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What updates do to a list, of which only ``pos`` and ``url`` are read.

    The changes, one row for each entry they hit (``pos``, ``_new``, ``_title``),
    and the entries to append.
    """
    updates, n = counted(updates, "updates")
    hits = (
        _named(updates)
        .join(watchlist.select(F.col("url").alias("_url"), "pos"), "_url")
        .groupBy("seq")
        .agg(F.min("pos").alias("_target"))
    )
    hits, n_hits = counted(hits, "hits")
    every_one_hits = n == n_hits
    if every_one_hits:
        # each has an entry of its own: none goes on from another, none is appended
        aimed = updates.join(hits, "seq").withColumn("_root", F.col("seq"))
    else:
        open_ = updates.join(hits, "seq", "left_anti")
        roots = chain.ends(_linked(updates, open_), "seq", "_from", "_root")
        # Roots are few or the updates themselves; an update's target is that of its root.
        targets = hits.withColumnRenamed("seq", "_root")
        aimed = written(updates.join(roots, "seq").join(targets, "_root", "left"), "aimed")
    title = F.max_by("title", F.when(F.col("title") != "", F.col("seq"))).alias("_title")
    row = F.max(F.struct("seq", "url", "search")).alias("_new")
    changes = aimed.where(F.col("_target").isNotNull()).groupBy(F.col("_target").alias("pos")).agg(row, title)
    fresh = aimed.where(F.col("_target").isNull()).groupBy("_root").agg(row, title)
    end = F.lit(0) if every_one_hits else watchlist.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("end")).scalar()
    appended = ordered.number_rows(fresh, [], "_root", "_n").select(
        (end + F.col("_n")).alias("pos"),
        F.col("_new.url").alias("url"),
        F.coalesce("_title", F.lit("")).alias("title"),
        F.col("_new.search").alias("search"),
    )
    return changes, appended


def _named(updates: DataFrame) -> DataFrame:
    """The one or two urls each update looks an entry up by."""
    urls = F.array_distinct(F.array("url", F.coalesce("replacing", "url")))
    return updates.select("seq", F.explode(urls).alias("_url"))


def _linked(updates: DataFrame, open_: DataFrame) -> DataFrame:
    """Every update with the one it goes on from, as ``_from``; null for those that start from the list or from nothing."""
    nobody = F.lit(None).cast(updates.schema["seq"].dataType)
    gives = updates.select("seq", F.col("url").alias("_url"), F.col("seq").alias("_by"), F.lit(1).alias("_gives"))
    asks = _named(open_).select("seq", "_url", nobody.alias("_by"), F.lit(0).alias("_gives"))
    # an update does not go on from itself: it asks before it gives
    seen = ordered.scan(gives.unionByName(asks), ["_url"], "seq", {"_from": ordered.known_before("_by")}, ties=["_gives"])
    last = seen.where("_gives = 0").groupBy("seq").agg(F.max("_from").alias("_from"))
    return updates.select("seq").join(last, "seq", "left")


def _series_visits(watchlist: DataFrame, listings: DataFrame, episodes: DataFrame) -> DataFrame:
    """What visits to the series entries read: each listed episode once, at its first place."""
    series = watchlist.where("NOT chain AND NOT search").select(F.col("pos").alias("entry"), F.col("url").alias("series_url"))
    listed = series.join(listings.withColumnRenamed("pos", "depth"), "series_url")
    once = listed.groupBy("entry", F.col("episode_url").alias("url")).agg(F.min("depth").alias("depth"))
    return once.join(episodes.select("url", "series_title", "status"), "url")


def standings(ranks: Ranks, visits: DataFrame) -> DataFrame:
    """What a walk from each node would find on the rest of its path: one row per node.

    ``visits``: ``url``, ``series_title``, ``status``, one row per url. Gives
    ``path`` and ``place``, ``pending`` (the first locked episode), ``last`` (url
    and title of the last one) and ``open`` (true if one is not locked). On a
    loop the rest is the whole loop. One ordered scan of the placed nodes works
    them out for all entries, however many walk the same chain.
    """
    told = visits.select(F.col("url").alias("node"), "series_title", "status", F.lit(True).alias("_told"))
    rows = ranks.placed.join(told, "node", "left").join(ranks.paths.select("path", "loop"), "path")
    locked = F.col("status") == "locked"
    rows = rows.select(
        "path",
        "place",
        "loop",
        F.when(locked, F.col("node")).alias("_locked"),
        F.when(locked, F.struct("place", F.col("node").alias("url"))).alias("_locked_at"),
        F.when(F.col("_told"), F.struct("place", F.col("node").alias("url"), F.col("series_title").alias("title"))).alias("_seen"),
        F.when(~locked, F.lit(True)).alias("_open"),
    )
    scanned = ordered.scan(
        rows,
        ["path"],
        "place",
        {
            "_pending": ordered.known_after("_locked", inclusive=True),
            "_open_on": ordered.known_after("_open", inclusive=True),
            "_seen_before": ordered.known_before("_seen"),
            "_first_locked": ordered.whole(F.min, "_locked_at"),
            "_last_seen": ordered.whole(F.max, "_seen"),
            "_any_open": ordered.whole(F.max, "_open"),
        },
    )
    on_loop = F.col("loop")
    ahead = F.when(F.col("_last_seen.place") >= F.col("place"), F.col("_last_seen"))
    return scanned.select(
        "path",
        "place",
        F.when(on_loop, F.coalesce("_pending", "_first_locked.url")).otherwise(F.col("_pending")).alias("pending"),
        F.when(on_loop, F.coalesce("_seen_before", "_last_seen")).otherwise(ahead).alias("last"),
        F.coalesce(F.when(on_loop, F.col("_any_open")).otherwise(F.col("_open_on")), F.lit(False)).alias("open"),
    )


def _chain_stands(ranks: Ranks, seeds: DataFrame, visits: DataFrame) -> DataFrame:
    """Where walks from the seeds (``entry``, ``start``) come to stand: ``entry``, ``url``, ``series_title``."""
    parts = chain.stretches(ranks, seeds, "start").select("entry", "_hop", F.col("_path").alias("path"), F.col("_entry").alias("place"))
    found = parts.join(standings(ranks, visits), ["path", "place"])
    if ranks.exits:
        found = found.groupBy("entry").agg(
            F.min_by("pending", F.when(F.col("pending").isNotNull(), F.col("_hop"))).alias("pending"),
            F.max_by("last", F.when(F.col("last").isNotNull(), F.col("_hop"))).alias("last"),
            F.some("open").alias("open"),
        )
    return found.where("open").select("entry", F.coalesce("pending", "last.url").alias("url"), F.col("last.title").alias("series_title"))


def moves(
    watchlist: DataFrame, edges: DataFrame | Ranks, episodes: DataFrame, listings: DataFrame | None = None
) -> DataFrame:
    """The updates a patrol of some entries gives, as ``upsert`` takes them; see ``patrol``."""
    ranks = edges if isinstance(edges, Ranks) else ranking.ranked(edges, "url", "next_url")
    seeds = watchlist.where("chain").select(F.col("pos").alias("entry"), F.col("url").alias("start"))
    visits = episodes.select("url", "series_title", "status")
    stands = _chain_stands(ranks, seeds, visits).withColumn("_stays", F.lit(False))
    if listings is not None:
        seen = _series_visits(watchlist, listings, visits)
        series = next_entries(seen, "entry", "depth", "url", "series_title", "status")
        stands = stands.unionByName(series.withColumn("_stays", F.lit(True)))
    moved = watchlist.select(F.col("pos").alias("entry"), F.col("url").alias("replacing")).join(stands, "entry")
    return moved.select(
        F.col("entry").alias("seq"),
        F.when(F.col("_stays"), F.col("replacing")).otherwise(F.col("url")).alias("url"),
        "replacing",
        F.col("series_title").alias("title"),
        F.lit(False).alias("search"),
    )


def patrol(
    watchlist: DataFrame, edges: DataFrame | Ranks, episodes: DataFrame, listings: DataFrame | None = None
) -> DataFrame:
    """Re-visit every entry of the watch list and give the list to keep.

    ``watchlist``: ``pos``, ``url``, ``title``, ``search``, ``chain`` (a chain
    entry is walked on from its episode). ``edges``: ``url``, ``next_url``, or
    these already ranked. ``episodes``: ``url``, ``series_title``, ``status``.
    ``listings``: ``series_url``, ``pos``, ``episode_url``; a series entry visits
    the episodes listed there, stays where it is and takes the title of the
    last. An entry without an episode, or with locked ones only, is kept as it
    is; so is a search entry, whose links ``seriatim.visits.search_again`` gives.
    """
    return upsert(watchlist.select("pos", "url", "title", "search"), moves(watchlist, edges, episodes, listings))


def transitions(observed: DataFrame, key: str, order: str, state: str, frm: str, to: str) -> DataFrame:
    """Observations where a key's state turned from ``frm`` to ``to`` since the one before."""
    seen = ordered.neighbours(observed, [key], order, state, "_before", "_after")
    return seen.where((F.col("_before") == frm) & (F.col(state) == to)).drop("_before", "_after")
