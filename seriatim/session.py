"""A session with the settings every job should use; a local one unless a master is configured."""

from __future__ import annotations

import os

from pyspark import SparkConf
from pyspark.sql import SparkSession


def session(name: str = "seriatim", cpus: str | None = None) -> SparkSession:
    cores = cpus or os.environ.get("BENCH_CPUS") or "8"
    builder = SparkSession.builder.appName(name)
    if not SparkConf().contains("spark.master"):
        # one machine: as many partitions as cores; a cluster keeps its own numbers
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.driver.memory", "8g")
            .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        )
    spark = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
