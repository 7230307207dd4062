"""The shared folder for tables a job writes on its way."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Paths handed out and not yet removed, by application; the driver's own names of folders, no data.
_handed_out: dict[str, set[str]] = {}
#: Where a table that ``written`` gave lies.
_lies_at: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, else the one given to ``setCheckpointDir``.

    Only a local session without one gets a folder of its own: on a cluster a
    machine's own folder would be lost with the machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder no other run uses."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _handed_out.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever Spark keeps it; nothing where there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Remove a table that ``written`` gave and that no plan in use reads any more."""
    path = _lies_at.pop(df, None)
    if path is not None:
        delete(df.sparkSession, path)
        _handed_out[df.sparkSession.sparkContext.applicationId].discard(path)


def cleanup(spark: SparkSession) -> int:
    """Remove what this application has left in the shared folder; how many tables that were.

    To be called once the results are consumed: DataFrames that read those tables fail afterwards.
    """
    paths = _handed_out.pop(spark.sparkContext.applicationId, set())
    for path in paths:
        delete(spark, path)
    return len(paths)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read back.

    Cuts the lineage of an iterating job: a lost executor costs a re-read, and
    the next plan starts from real file sizes.
    """
    return counted(df, name)[0]


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``written``, with the number of rows the write itself counted."""
    table, seen = measured(df, name)
    return table, seen["rows"]


def measured(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``written``, with ``rows`` and further aggregates the write itself worked out."""
    spark = df.sparkSession
    path, seen = new_path(spark, name), Observation()
    also = [value.alias(key) for key, value in counts.items()]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *also).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _lies_at[table] = path
    return table, seen.get
