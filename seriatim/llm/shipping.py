"""Makes this package known to Python workers that cannot import it by themselves."""

from __future__ import annotations

import os
import shutil
import sys
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the session's Python files, once, unless workers find it on the path they inherit.

    Spark hands the archive to its workers itself; the file is the driver's own.
    """
    inherited = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    if context.applicationId not in _SENT and not any(p and Path(p).resolve() == ROOT for p in inherited):
        folder = Path(tempfile.mkdtemp(prefix="package-"))
        copy = folder / "package"
        shutil.copytree(ROOT / "seriatim", copy / "seriatim", ignore=shutil.ignore_patterns("__pycache__"))
        before = list(sys.path)
        context.addPyFile(shutil.make_archive(str(folder / "seriatim"), "zip", copy))
        sys.path[:] = before
        _SENT.add(context.applicationId)
    return spark
