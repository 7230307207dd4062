"""A watch list kept in ranges of positions, of which an update rewrites those it hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seriatim.operators import watch
from seriatim.streaming import batches

#: Positions of one range.
RANGE = 100_000


def _range(width: int) -> Column:
    return F.expr(f"pos DIV {width}").alias(batches.BUCKET)


def save(watchlist: DataFrame, path: str, version: int = 0, width: int = RANGE) -> None:
    """Keep a whole list as this version."""
    batches.write_buckets(watchlist.select("*", _range(width)), path, version)


def load(spark: SparkSession, path: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The list as the last version, or the last before one, left it."""
    return batches.read_buckets(spark, path, schema, before=before)


def update(spark: SparkSession, path: str, schema: StructType, updates: DataFrame, version: int, width: int = RANGE) -> list[int]:
    """Apply updates (see ``watch.upsert``) to a kept list; the ranges that were written anew.

    Only positions and urls are read of the whole list. The ranges with a change
    and those that entries are appended to are read and replaced; other columns
    of appended entries are null.
    """
    held = load(spark, path, schema, version)
    changes, appended = watch.resolved(held.select("pos", "url"), updates)
    hit = batches.buckets_in(changes.select("pos").unionByName(appended.select("pos")), _range(width))
    if hit:
        rows = watch.changed(batches.read_buckets(spark, path, schema, hit, version), changes)
        rows = rows.unionByName(appended, allowMissingColumns=True)
        batches.write_buckets(rows.select("*", _range(width)), path, version, named=hit)
    return hit
