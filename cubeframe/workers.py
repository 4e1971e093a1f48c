"""How Python workers find this package, how much they get at once, and how they give memory back."""

from __future__ import annotations

import contextlib
import ctypes
import os

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of rows that go to a Python worker at once (one longer row goes alone): Spark's own limit is 10,000 rows, however long.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def reachable(spark: SparkSession | None = None) -> None:
    """Let Python workers started from here on import the package from where the driver did (on a cluster, ship it with ``--py-files``)."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def ship(spark: SparkSession | None = None) -> None:
    """Prepare the session for Python workers: they find the package, and get batches of bounded size."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    reachable(spark)
    spark.conf.set(_LIMIT, str(BATCH_BYTES))


def release() -> None:
    """Hand free memory back to the system: workers live on after their task, and what their allocators hold would add up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
