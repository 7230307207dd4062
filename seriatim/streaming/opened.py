"""Entries that were locked when last looked at and are readable now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from seriatim.operators import ordered
from seriatim.sources.shared import discard, measured, written
from seriatim.streaming import batches

TURNED = "turned"


def run(
    stream: DataFrame, key: str, order: str, state: str, frm: str, to: str, path: str, checkpoint: str,
    buckets: int = batches.BUCKETS,
) -> None:
    """Write decisions under ``path``/found, observations under ``path``/seen, the last state per key under ``path``/last.

    A batch sees the last state each of its keys had before it, so a turn
    between two batches is found as well. Where an observation lands after a
    later one of its key, the batch reads that key's history and decides again
    on the observations its own ones stand before; only then is history read.
    Last states and history lie in buckets by key: a batch reads and replaces
    those its own keys name. ``order`` tells the observations of a key apart and
    holds no nulls.
    """
    at_found, at_seen, at_last = f"{path}/found", f"{path}/seen", f"{path}/last"
    bucket = batches.bucket_of(key, buckets=buckets)

    def latest(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(F.max(order).alias(order), F.max_by(state, order).alias(state))

    def before_(spark: SparkSession, seen: DataFrame, last: DataFrame, batch_id: int) -> DataFrame:
        """The observations a batch's own ones are held against: the last of each key, or all of one that are late."""
        # a struct holds a null key like any other
        first = seen.groupBy(F.struct(key).alias("_key")).agg(F.min(order).alias("_first"))
        keyed = last.withColumn("_key", F.struct(key)).join(first, "_key").withColumn(batches.BUCKET, bucket)
        met, counts = measured(keyed, "held", late=F.count_if(F.col("_first") < F.col(order)))
        if not counts["late"]:
            return met
        late = met.where(F.col("_first") < F.col(order))
        history = batches.read_buckets(spark, at_seen, seen.schema, batches.buckets_in(late), batch_id, whole=False)
        again = history.withColumn("_key", F.struct(key)).join(late.select("_key"), "_key", "left_semi")
        rest = met.join(late.select("_key"), "_key", "left_anti")
        return rest.select(*seen.columns).unionByName(again.select(*seen.columns))

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = written(batch.select(key, order, state), "seen")
        rows = seen.withColumn("_new", F.lit(True))
        mine = batches.buckets_in(seen, bucket) if batch_id else []
        last = batches.read_buckets(spark, at_last, seen.schema, mine, batch_id)
        if mine:
            before = before_(spark, seen, last, batch_id)
            rows = rows.unionByName(before.select(key, order, state, F.lit(False).alias("_new")))
        # one value of both: a state may be null, the row before may not be there
        rows = rows.withColumn("_it", F.struct(F.col(state).alias("state"), "_new"))
        placed = ordered.scan(rows, [key], order, {"_before": ordered.before("_it")})
        turned = F.coalesce((F.col("_before.state") == frm) & (F.col(state) == to), F.lit(False))
        again = ~F.col("_new") & F.coalesce("_before._new", F.lit(False))
        decided = placed.withColumn(TURNED, turned).where((F.col("_new") & F.col(TURNED)) | again)
        batches.write_batch(decided.select(key, order, state, TURNED), at_found, batch_id)
        batches.write_buckets(seen.withColumn(batches.BUCKET, bucket), at_seen, batch_id, whole=False)
        replaced = latest(last.unionByName(seen)).withColumn(batches.BUCKET, bucket)
        batches.write_buckets(replaced, at_last, batch_id, named=mine)
        discard(seen)

    batches.run_available(stream, handle, checkpoint)


def found(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All transitions as the last decision on each has it; ``schema`` is that of the key, order and state columns."""
    key, order, state = schema.names
    stored = StructType([*schema.fields, StructField(TURNED, BooleanType())])
    decided = batches.read_batches(spark, f"{path}/found", stored)
    last = F.max_by(F.struct(state, TURNED), batches.BATCH).alias("_last")
    return decided.groupBy(key, order).agg(last).where(f"_last.{TURNED}").select(key, order, f"_last.{state}")
