"""Tables that grow by one folder per micro-batch.

A batch writes what it adds under its own id and overwrites only that, so a
batch run twice leaves what it left the first time. Writing costs what a batch
brings. State is merged when read, from the latest snapshot and the batches
since; what no batch reads again is removed.

State that batches look up by key lies in buckets (``bucket=K/batch=B``): a
batch lists, reads and writes those its own keys name and no others. A kept
bucket is replaced as a whole under the batch's id, and the version before
stays until the next one, so that a batch can run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from seriatim.sources.shared import delete

BATCH, BUCKET = "batch", "bucket"
#: Buckets of a state that is looked up by key, unless a job says otherwise: many enough that one is quickly rewritten.
BUCKETS = 16


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: StructType, before: int | None = None) -> DataFrame:
    """All batches written so far, or those before one; no rows where none is."""
    stored = StructType([*schema.fields, StructField(BATCH, LongType())])
    df = spark.read.schema(stored).option("basePath", path).parquet(path)
    return df if before is None else df.where(F.col(BATCH) < before)


#: Batches between two snapshots of a state table.
SNAPSHOT_EVERY = 100

Merge = Callable[[DataFrame], DataFrame]


def last_snapshot(before: int, every: int = SNAPSHOT_EVERY) -> int:
    """The latest batch before this one that began with a snapshot; 0 for none."""
    return max(before - 1, 0) // every * every


def read_state(
    spark: SparkSession, path: str, schema: StructType, merge: Merge, before: int, every: int = SNAPSHOT_EVERY
) -> DataFrame:
    """The state all batches before this one add up to: the latest snapshot and the batches since.

    ``merge`` folds rows of one key into one and can fold its own results again.
    """
    since = last_snapshot(before, every)
    deltas = read_batches(spark, f"{path}/delta", schema, before).where(F.col(BATCH) >= since).drop(BATCH)
    if since == 0:
        return merge(deltas)
    held = read_batches(spark, f"{path}/snapshot", schema).where(F.col(BATCH) == since).drop(BATCH)
    return merge(held.unionByName(deltas))


def write_state(
    spark: SparkSession, df: DataFrame, path: str, merge: Merge, batch_id: int, every: int = SNAPSHOT_EVERY
) -> None:
    """Add a batch's own merged rows; every so many batches first fold what came before into a snapshot.

    The batches and the snapshot that the snapshot before holds are removed
    then: this batch run again reads from that one on.
    """
    if batch_id > 0 and batch_id % every == 0:
        write_batch(read_state(spark, path, df.schema, merge, batch_id, every), f"{path}/snapshot", batch_id)
        folded = range(max(batch_id - 2 * every, 0), batch_id - every)
        for old in folded:
            delete(spark, f"{path}/delta/{BATCH}={old}")
        if folded:
            delete(spark, f"{path}/snapshot/{BATCH}={folded[0]}")
    write_batch(merge(df), f"{path}/delta", batch_id)


def batches_written(spark: SparkSession, path: str, schema: StructType) -> int:
    """How many batches a state table has: one more than its last batch."""
    last = read_batches(spark, f"{path}/delta", schema).select(F.max(BATCH).alias("last")).first()["last"]
    return 0 if last is None else last + 1


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand everything that has landed to ``handle``, batch by batch, then stop."""
    started = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()


def landed_stream(spark: SparkSession, folder: str, name: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the files of one table as they land: a folder ``<name>.parquet``, or the one file of that name."""
    # as a pattern, which only this name meets: a plain path would have to be a folder
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{folder}/{name}[.]parquet")
    )


def bucket_of(*keys: str, buckets: int = BUCKETS) -> Column:
    """The bucket of a key; nulls have one like any other value."""
    return F.pmod(F.xxhash64(F.struct(*keys)), F.lit(buckets)).cast("bigint")


def buckets_in(df: DataFrame, bucket: Column | str = BUCKET) -> list[int]:
    """The buckets some rows name: at most as many as there are."""
    named = df.select(F.col(bucket) if isinstance(bucket, str) else bucket).distinct()
    return sorted(r[0] for r in named.collect())


def _folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the folders ``name=<number>`` at a path, rising; none where there is no such path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    found = [f.getPath().getName() for f in system.listStatus(at)]
    return sorted(int(f.removeprefix(f"{name}=")) for f in found if f.startswith(f"{name}="))


def _versions(spark: SparkSession, path: str, buckets: list[int] | None, before: int | None) -> dict[int, list[int]]:
    """The batches that wrote to each bucket, of some or all."""
    some = _folders(spark, path, BUCKET) if buckets is None else buckets
    found = {k: _folders(spark, f"{path}/{BUCKET}={k}", BATCH) for k in some}
    return {k: kept for k, v in found.items() if (kept := [b for b in v if before is None or b < before])}


def read_buckets(
    spark: SparkSession, path: str, schema: StructType, buckets: list[int] | None = None, before: int | None = None, *, whole: bool = True
) -> DataFrame:
    """What lies in some buckets (all where none are named), as left by the batches before one.

    Only these buckets' files are listed and scanned. With ``whole`` the last
    version of a bucket is all of it, else every batch added to it.
    """
    versions = _versions(spark, path, buckets, before)
    paths = [f"{path}/{BUCKET}={k}/{BATCH}={b}" for k, v in versions.items() for b in (v[-1:] if whole else v)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def write_buckets(df: DataFrame, path: str, batch_id: int, *, whole: bool = True, named: list[int] | None = None) -> None:
    """Write rows with a column ``bucket`` as this batch's part of their buckets; the same batch overwrites itself.

    With ``whole`` the rows are all that their buckets hold from now on, and
    versions before the last are removed, of the ``named`` buckets if it is
    known which these are. Rows of a bucket are brought together
    before they are written; Spark splits those of a bucket that is large.
    """
    spark = df.sparkSession
    parts = df.withColumn(BATCH, F.lit(batch_id).cast("bigint")).hint("rebalance", BUCKET)
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET, BATCH).parquet(path)
    if not whole:
        return
    for bucket, versions in _versions(spark, path, named, batch_id).items():
        for old in versions[:-1]:
            delete(spark, f"{path}/{BUCKET}={bucket}/{BATCH}={old}")
