"""What became of episodes and works."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriatim.functions.text import first_text, path_segment

#: Statuses in the order a work's summary names them, and how it shows them.
STATUSES = ("saved", "exists", "locked")
SHOWN = {"saved": "saved", "exists": "skipped", "locked": "locked"}


def known(flag: Column) -> Column:
    """A flag whose absence means no."""
    return F.coalesce(flag, F.lit(False))


def open_or_bought(public: Column, bought: Column) -> Column:
    return known(public) | known(bought)


def not_for_sale(price: Column, bought: Column, *cut_short: Column) -> Column:
    """Neither for sale and unbought, nor served with pages left out."""
    for_sale = (F.coalesce(price, F.lit(0)) > 0) & ~known(bought)
    short = F.lit(False)
    for left in cut_short:
        short = short | (F.coalesce(left, F.lit(0)) > 0)
    return ~(for_sale | short)


def readable_by_rule(rule: Column, predicates: Mapping[str, Column], otherwise: Column | None = None) -> Column:
    """Each rule's own predicate; how a user adds one for a site."""
    result = known(otherwise) if otherwise is not None else F.lit(False)
    for name, predicate in predicates.items():
        result = F.when(rule == name, known(predicate)).otherwise(result)
    return result


def result_status(pages_there: Column, archive_there: Column, readable: Column) -> Column:
    """``exists``, ``locked`` or ``saved``; pages there without their archive count as saved, readable or not."""
    return (
        F.when(pages_there & archive_there, F.lit("exists"))
        .when(~pages_there & ~readable, F.lit("locked"))
        .otherwise(F.lit("saved"))
    )


def summarise(results: DataFrame, folders: DataFrame, work: Sequence[str], title: str, folder: str, status: str) -> DataFrame:
    """One line per work: ``level``, ``lead``, counts and ``message``.

    ``folders`` names each work's directory (columns ``work`` or some of them,
    and ``folder``). Results are counted first, combined before the shuffle, so
    names meet one row per work. A work without a folder row has an empty folder name.
    """
    counts = {s: F.count_if(F.col(status) == s).alias(s) for s in STATUSES}
    told = results.groupBy(*work).agg(
        *counts.values(),
        F.count(F.lit(1)).alias("episodes"),
        F.min(title).alias("_title"),
    )
    told = told.join(folders.withColumnRenamed(folder, "_folder"), [c for c in work if c in folders.columns], "left")
    told = told.withColumn("_folder", F.coalesce("_folder", F.lit("")))
    lead = F.coalesce(*[F.when(F.col(s) > 0, F.lit(s)) for s in STATUSES])
    rest = [
        F.when((F.col(s) > 0) & (F.col("lead") != s), F.concat(F.col(s).cast("string"), F.lit(f" {SHOWN[s]}")))
        for s in STATUSES
    ]
    led = F.coalesce(*[F.when(F.col("lead") == s, F.col(s)) for s in STATUSES]).cast("string")
    shown = F.coalesce(*[F.when(F.col("lead") == s, F.lit(SHOWN[s])) for s in STATUSES])
    many = F.concat(
        shown, F.lit(": "), F.col("_folder"), F.lit(" ("),
        F.concat_ws(", ", F.concat(led, F.lit(" episodes")), *rest), F.lit(")"),
    )
    # The wording of the line for one locked episode.
    locked = F.concat(F.lit("skip: '"), F.col("_title"), F.lit("' needs a purchase, a wait or a login."))
    save_dir = F.concat_ws("/", "_folder", path_segment(F.col("_title")))
    one = F.when(F.col("lead") == "locked", locked).otherwise(F.concat(shown, F.lit(": "), save_dir))
    return (
        told.withColumn("lead", lead)
        .withColumn("level", F.when(F.col("lead") == "locked", F.lit("warning")).otherwise(F.lit("info")))
        .withColumn("message", F.when(F.col("episodes") == 1, one).otherwise(many))
        .drop("_title", "_folder")
    )


def nothing_readable(works: DataFrame, results: DataFrame, work: Sequence[str], status: str) -> DataFrame:
    """Works whose every result is locked, works without any result included."""
    open_works = results.where(F.col(status) != "locked").select(*work).distinct()
    return works.join(open_works, list(work), "left_anti")


def available(pages: Column, notice: Column, expired_notice: str) -> Column:
    """An episode's page count: none once its notice says it has expired."""
    return F.when(F.contains(F.coalesce(notice, F.lit("")), F.lit(expired_notice)), F.lit(0)).otherwise(pages)


def first_known(df: DataFrame, work: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Per work the first value of each field that says something, ``""`` when none does."""
    key = F.struct(*order)
    picks = [
        F.coalesce(F.min_by(f, F.when(first_text(F.col(f)) != "", key)), F.lit("")).alias(f) for f in fields
    ]
    return df.groupBy(*work).agg(*picks)
