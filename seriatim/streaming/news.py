"""Items the first time they are seen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seriatim.sources.shared import discard, written
from seriatim.streaming import batches


def new_items(stream: DataFrame, keys: Sequence[str], at: str, keep_for: str) -> DataFrame:
    """Each item once within ``keep_for`` of its event time.

    The watermark bounds the state: an item seen again later than that counts
    as new; ``first_seen`` never forgets.
    """
    return stream.withWatermark(at, keep_for).dropDuplicatesWithinWatermark(list(keys))


def first_seen(stream: DataFrame, keys: Sequence[str], path: str, checkpoint: str, buckets: int = batches.BUCKETS) -> None:
    """Each item once, however far apart its sightings lie: a batch keeps what no earlier batch wrote.

    What was written is the state, so none is held in memory and none expires.
    It lies in buckets by key, and a batch reads those of its own items alone.
    """
    key = F.struct(*keys).alias("_key")  # nulls are equal in it
    bucket = batches.bucket_of(*keys, buckets=buckets)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        items = batch.select(*keys).distinct()
        fresh = items
        if batch_id > 0:
            items = written(items, "items")
            mine = batches.buckets_in(items, bucket)
            held = batches.read_buckets(spark, path, items.schema, mine, batch_id, whole=False)
            fresh = items.select("*", key).join(held.select(key), "_key", "left_anti").drop("_key")
        batches.write_buckets(fresh.withColumn(batches.BUCKET, bucket), path, batch_id, whole=False)
        discard(items)

    batches.run_available(stream, handle, checkpoint)


def seen(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All items ``first_seen`` has written."""
    return batches.read_buckets(spark, path, schema, whole=False)


def write_available(items: DataFrame, path: str, checkpoint: str) -> None:
    """Write what has landed to a folder, once per item, then stop."""
    started = (
        items.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
