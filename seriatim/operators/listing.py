"""Listings put into reading order, and places and neighbours in them.

A listing has one row per printed entry: group columns (the series), ``pos``
(where it is printed) and the entry's own columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriatim.functions.text import fold_digits, label_number
from seriatim.operators import ordered
from seriatim.sources.shared import written


def newest_first(df: DataFrame, series: Sequence[str], item: str, pos: str, *, reverse_then_dedup: bool = False):
    """A listing printed newest first as reading order: one row per item, ``place`` from 1.

    De-duplicating first keeps an item where it is printed first; reversing
    first keeps it where it is printed last. Both are read from the end.
    """
    once = df.groupBy(*series, item).agg((F.max(pos) if reverse_then_dedup else F.min(pos)).alias(pos))
    return ordered.number_rows(once, series, pos, "place", ties=[item], descending=True)


def directed(df: DataFrame, directions: DataFrame, series: Sequence[str], item: str, pos: str, newest_first: str):
    """Reading order where ``directions`` says of each series whether it is printed newest first.

    Items are made unique before the directions are joined on, which keeps a
    series' repeats out of the join.
    """
    once = df.groupBy(*series, item).agg(F.min(pos).alias(pos))
    keyed = once.join(directions, list(series)).withColumn("_key", F.when(F.col(newest_first), -F.col(pos)).otherwise(F.col(pos)))
    return ordered.number_rows(keyed, series, "_key", "place", ties=[item]).drop("_key", newest_first)


def by_site_key(df: DataFrame, series: Sequence[str], key: str, pos: str, *, last_printed_first: bool = True):
    """Sort by the site's order number, missing ones as 0; ties by print order, the last first or the first.

    Any number of rows may miss their key, so groups are cut by ranges of the whole order.
    """
    tie = -F.col(pos) if last_printed_first else F.col(pos)
    keyed = df.withColumn("_key", F.coalesce(F.col(key), F.lit(0))).withColumn("_tie", tie)
    cut = ordered.range_blocks(keyed, series, ["_key", "_tie"])
    return ordered.number_rows(cut, series, "_key", "place", ties=["_tie"]).drop("_key", "_tie")


def by_label_number(df: DataFrame, series: Sequence[str], item: str, label: str, pos: str) -> DataFrame:
    """Sort by the numbers in the labels when every item has one of its own, else read from the end.

    Numbers that settle the order are unique in their series, and so are
    positions: either way the key is a position.
    """
    once = ordered.first_of_each(df, [*series, item], pos, [label])
    once = written(once.withColumn("_number", label_number(F.col(label))), "labels")
    # Two steps keep the distinct count combinable: per (series, number) first, then per series.
    numbers = once.groupBy(*series, "_number").agg(F.count(F.lit(1)).alias("_n"))
    told = numbers.groupBy(*series).agg(
        (F.max("_n") == 1).alias("_unique"), F.every(F.col("_number").isNotNull()).alias("_all")
    )
    numbered = F.col("_unique") & F.col("_all")
    keyed = once.join(told, list(series)).withColumn(
        "_key", F.when(numbered, F.col("_number")).otherwise(-F.col(pos))
    )
    return ordered.number_rows(keyed, series, "_key", "place").drop("_key", "_number", "_unique", "_all")


#: A composite episode name: letters, a number, the rest.
EPISODE_NAME = r"^([^0-9]*)([0-9]+(?:\.[0-9]+)?)(.*)$"


def name_key(name: Column) -> Column:
    """``01`` < ``12.5`` < ``jk01``: letters, then the number, then the rest; a name without a number sorts by itself.

    Full-width digits count as digits.
    """
    name = fold_digits(name)
    number = F.regexp_extract(name, EPISODE_NAME, 2)
    shaped = number != ""
    return F.struct(
        F.when(shaped, F.regexp_extract(name, EPISODE_NAME, 1)).otherwise(name).alias("letters"),
        F.when(shaped, F.nullif(number, F.lit("")).try_cast("double")).otherwise(F.lit(float("inf"))).alias("number"),
        F.when(shaped, F.regexp_extract(name, EPISODE_NAME, 3)).otherwise(F.lit("")).alias("rest"),
    )


def by_name(df: DataFrame, series: Sequence[str], name: str, pos: str) -> DataFrame:
    """One row per name (the first printed), in composite-name order, ``place`` from 1."""
    once = ordered.first_of_each(df, [*series, name], pos).withColumn("_key", name_key(F.col(name)))
    cut = ordered.range_blocks(once, series, ["_key", name])
    return ordered.number_rows(cut, series, "_key", "place", ties=[name]).drop("_key")


def by_number(df: DataFrame, series: Sequence[str], number: str, pos: str, keep: Sequence[str], ties: Sequence[str] = ()):
    """One row per number, the first printed; rows without a number are dropped; ``place`` in number order."""
    once = ordered.first_of_each(df.where(F.col(number).isNotNull()), [*series, number], pos, keep, ties=ties)
    return ordered.number_rows(once, series, number, "place")


def open_neighbours(df: DataFrame, series: Sequence[str], pos: str, item: str, flag: str, before: str, after: str):
    """The nearest open items around each row; the printed neighbours in a series without any flags."""
    marked = df.withColumn("_open", F.when(F.col(flag), F.col(item)))
    marked = marked.withColumn("_flagged", F.col(flag).isNotNull())
    near = ordered.scan(
        marked,
        series,
        pos,
        {
            "_before": ordered.known_before("_open"),
            "_after": ordered.known_after("_open"),
            "_prev": ordered.before(item),
            "_next": ordered.after(item),
            "_told": ordered.whole(F.max, "_flagged"),
        },
    )
    return (
        near.withColumn(before, F.when(F.col("_told"), F.col("_before")).otherwise(F.col("_prev")))
        .withColumn(after, F.when(F.col("_told"), F.col("_after")).otherwise(F.col("_next")))
        .drop("_open", "_flagged", "_told", "_before", "_after", "_prev", "_next")
    )


def around_number(
    listing: DataFrame, probes: DataFrame, series: Sequence[str], number: str, item: str, probe: str
) -> DataFrame:
    """For numbers that need not be listed: the last item before each and the first after it.

    ``listing`` has series, ``number``, ``item``; ``probes`` has series,
    ``number`` and an id column ``probe``. Of items sharing a number the
    greatest stands before, the least after. One pass over the union, no join
    of pairs: a listed number has a row below its probes, seen from below, and
    one above them, seen from above, so that one order serves both ways and may
    be cut into blocks anywhere.
    """
    keys = [*series, number]
    nothing, asker = F.lit(None).cast(listing.schema[item].dataType), F.lit(None).cast(probes.schema[probe].dataType)
    listed = listing.groupBy(*keys).agg(F.min(item).alias("_least"), F.max(item).alias("_greatest"))
    sides = F.array(
        F.struct(F.lit(0).alias("_side"), nothing.alias("_low"), F.col("_least").alias("_high")),
        F.struct(F.lit(2).alias("_side"), F.col("_greatest").alias("_low"), nothing.alias("_high")),
    )
    shown = listed.select(*keys, F.inline(sides)).withColumn(probe, asker)
    asked = probes.select(*keys, F.lit(1).alias("_side"), nothing.alias("_low"), nothing.alias("_high"), probe)
    cut = ordered.range_blocks(shown.unionByName(asked), series, [number, "_side", probe])
    outputs = {"before": ordered.known_before("_low"), "after": ordered.known_after("_high")}
    near = ordered.scan(cut, series, number, outputs, ties=["_side"])
    return near.where("_side = 1").select(*keys, probe, "before", "after")


def number_from_neighbours(before: Column, after: Column) -> Column:
    """The next item's number less one (0 counts as unknown), else the previous one's plus one."""
    known_after = F.when(after > 0, after)
    known_before = F.when(before > 0, before)
    return F.when(known_after.isNotNull(), F.nullif(known_after - 1, F.lit(0))).otherwise(known_before + 1)


def open_positions(flags: Column) -> Column:
    """Where, counted from 1, a list of flags is true."""
    marked = F.transform(flags, lambda f, i: F.when(f, i + 1))
    return F.filter(marked, lambda i: i.isNotNull())


def captions(df: DataFrame, block: Sequence[str], pos: str, link: str, caption: str) -> DataFrame:
    """Each link of a block with the last caption before it, ``""`` without one; a repeated link keeps its first.

    A row of ``df`` holds either a link or a caption, the other being null.
    """
    carried = ordered.scan(df, block, pos, {"_caption": ordered.known_before(caption)}).where(F.col(link).isNotNull())
    told = carried.withColumn("_caption", F.coalesce("_caption", F.lit("")))
    return ordered.first_of_each(told, [*block, link], pos, ["_caption"]).withColumnRenamed("_caption", caption)


def running_places(df: DataFrame, group: Sequence[str], page_no: str, pos: str, item: str, *, pages_per_task: int = 10_000):
    """Distinct items numbered over all listing pages so far, in page then print order."""
    once = ordered.first_of_each(df, [*group, item], page_no, [pos], ties=[pos])
    return ordered.number_rows(once, group, page_no, "place", ties=[pos], span=pages_per_task)
