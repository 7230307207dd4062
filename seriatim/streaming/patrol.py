"""Patrol as observations land: statuses and the watch list, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from seriatim.operators import chain, ranking, watch
from seriatim.operators.ranking import Ranks
from seriatim.sources.shared import discard, written
from seriatim.streaming import batches, kept_list


def _latest(observed: DataFrame) -> DataFrame:
    """The latest status of every episode: one row per (entry, episode), combined before the shuffle."""
    return observed.groupBy("entry", "episode").agg(
        F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"), F.sum("visits").alias("visits")
    )


def _last_standing(standings: DataFrame) -> DataFrame:
    """Where each entry stood after the last batch that brought news of it."""
    return standings.groupBy("entry").agg(F.max_by("episode", "at").alias("episode"), F.max("at").alias("at"))


SCHEMA = StructType(
    [
        StructField("entry", LongType()),
        StructField("episode", LongType()),
        StructField("seq", LongType()),
        StructField("status", StringType()),
        StructField("visits", LongType()),
    ]
)

_STANDING = StructType([StructField("entry", LongType()), StructField("episode", LongType()), StructField("at", LongType())])


def run(stream: DataFrame, path: str, checkpoint: str, buckets: int = batches.BUCKETS) -> None:
    """Fold a stream of observations (``entry``, ``episode``, ``seq``, ``status``) into catalogue and watch list under ``path``.

    Both lie in buckets by entry. A batch reads and replaces the buckets of the
    entries it has news of, and works out anew where these entries stand.
    """
    bucket = batches.bucket_of("entry", buckets=buckets)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = written(_latest(batch.select("entry", "episode", "seq", "status", F.lit(1).cast("bigint").alias("visits"))).select(*SCHEMA.names), "seen")
        held, mine = seen, batches.buckets_in(seen, bucket) if batch_id else []
        if mine:
            before = batches.read_buckets(spark, f"{path}/catalogue", SCHEMA, mine, batch_id)
            held = written(_latest(before.unionByName(seen.select(*SCHEMA.names))), "held")
        batches.write_buckets(held.withColumn(batches.BUCKET, bucket), f"{path}/catalogue", batch_id, named=mine)
        told = held.join(seen.select(F.struct("entry").alias("_key")).distinct(), F.struct("entry") == F.col("_key"), "left_semi")
        stands = watch.next_entries(told.withColumn("title", F.col("episode")), "entry", "episode", "episode", "title", "status")
        # an entry whose episodes have all become locked stays where it was
        moved = stands.withColumn("at", F.lit(batch_id).cast("bigint")).select(*_STANDING.names)
        stood = batches.read_buckets(spark, f"{path}/watchlist", _STANDING, mine, batch_id)
        batches.write_buckets(_last_standing(stood.unionByName(moved)).withColumn(batches.BUCKET, bucket), f"{path}/watchlist", batch_id, named=mine)
        discard(held)
        discard(seen)

    batches.run_available(stream, handle, checkpoint)


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The status of every episode seen so far, and how often it was visited."""
    return _latest(batches.read_buckets(spark, f"{path}/catalogue", SCHEMA))


def watchlist(spark: SparkSession, path: str) -> DataFrame:
    """Where every entry stands: its first locked episode, else the last one reached."""
    return batches.read_buckets(spark, f"{path}/watchlist", _STANDING).drop("at")


_VISITED = StructType(
    [
        StructField("url", StringType()),
        StructField("series_title", StringType()),
        StructField("status", StringType()),
        StructField("seq", LongType()),
    ]
)


def _last_visit(visited: DataFrame) -> DataFrame:
    """The latest visit of every episode, repeats combined before the shuffle."""
    last = F.max(F.struct("seq", "series_title", "status")).alias("_last")
    return visited.groupBy("url").agg(last).select("url", "_last.series_title", "_last.status", "_last.seq")


def rounds(
    stream: DataFrame, watched: DataFrame, edges: DataFrame, path: str, checkpoint: str, listings: DataFrame | None = None
) -> None:
    """A patrol of the watch list with every batch of visits, each going on from the list the one before left.

    ``stream``: ``url``, ``series_title``, ``status``, ``seq``. ``watched``,
    ``edges`` and ``listings`` as ``watch.patrol`` takes them; ``watched`` is the
    list before the first batch. A batch run again starts from the same list
    and leaves the same.

    Links are ranked once. The first batch visits every entry, since links may
    have changed since the list was left; the ones after it visit those entries
    alone whose chains or listings hold an episode the batch brings news of.
    Visits lie in buckets by chain, the list in ranges of positions: a batch
    reads the buckets its entries need and rewrites what it changes.
    """
    names = ["pos", "url", "title", "search", "chain"]
    schema = watched.select(*names).schema
    spark = watched.sparkSession
    ranks = ranking.ranked(edges, "url", "next_url")
    onto = ranks.placed.select(F.col("node").alias("url"), "path")
    whole_patrol = True

    def grouped(rows: DataFrame) -> DataFrame:
        """With the bucket of each url: that of its chain, or its own where it is on none."""
        chained = rows.join(onto, "url", "left").withColumn("_group", F.coalesce("path", "url"))
        return chained.withColumn(batches.BUCKET, batches.bucket_of("_group"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        nonlocal whole_patrol
        if batch_id == 0:
            kept_list.save(watched.select(*names), f"{path}/list")
        seen = written(grouped(_last_visit(batch.select(*_VISITED.names))), "seen")
        visited, told = seen, []
        if batch_id:
            told = batches.buckets_in(seen)
            before = batches.read_buckets(spark, f"{path}/visited", _VISITED, told, batch_id)
            visited = grouped(_last_visit(before.unionByName(seen.select(*_VISITED.names))))
        visited = visited.drop("path", "_group")
        batches.write_buckets(visited, f"{path}/visited", batch_id, named=told)
        held = kept_list.load(spark, f"{path}/list", schema, batch_id + 1)
        if whole_patrol:
            mine, needed, walked = held, None, ranks
        else:
            mine = written(_with_news(held, ranks, seen, listings), "entries")
            paths = written(_paths_of(mine, ranks).distinct(), "paths")
            here = paths.select(F.col("path").alias("_group"))
            if listings is not None:
                series = mine.where("NOT chain AND NOT search").select(F.col("url").alias("series_url"))
                listed = listings.join(series, "series_url", "left_semi").select(F.col("episode_url").alias("url"))
                here = here.unionByName(grouped(listed).select("_group"))
            needed = batches.buckets_in(here, batches.bucket_of("_group"))
            walked = Ranks(ranks.placed.join(paths, "path", "left_semi"), ranks.paths.join(paths, "path", "left_semi"), ranks.exits)
        visits = batches.read_buckets(spark, f"{path}/visited", _VISITED, needed, batch_id + 1)
        moves = watch.moves(mine, walked, visits, listings)
        kept_list.update(spark, f"{path}/list", schema, moves, batch_id + 1)
        whole_patrol = False
        discard(seen)

    batches.run_available(stream, handle, checkpoint)


def _paths_of(entries: DataFrame, ranks: Ranks) -> DataFrame:
    """The chains that walks from chain entries pass."""
    seeds = entries.where("chain").select("pos", F.col("url").alias("start"))
    return chain.stretches(ranks, seeds, "start").select(F.col("_path").alias("path"))


def _with_news(entries: DataFrame, ranks: Ranks, seen: DataFrame, listings: DataFrame | None) -> DataFrame:
    """The entries whose chains or listings hold an episode there is news of."""
    seeds = entries.where("chain").select("pos", F.col("url").alias("start"))
    parts = chain.stretches(ranks, seeds, "start").select("pos", F.col("_path").alias("path"))
    told = parts.join(seen.select("path").distinct(), "path", "left_semi").select("pos")
    if listings is not None:
        news = listings.join(seen.select(F.col("url").alias("episode_url")), "episode_url", "left_semi").select(F.col("series_url").alias("url"))
        series = entries.where("NOT chain AND NOT search").join(news, "url", "left_semi")
        told = told.unionByName(series.select("pos"))
    return entries.join(told.distinct(), "pos", "left_semi")


def rounds_list(spark: SparkSession, path: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The watch list as the last batch, or the one before a given batch, left it."""
    return kept_list.load(spark, f"{path}/list", schema, None if before is None else before + 1)
