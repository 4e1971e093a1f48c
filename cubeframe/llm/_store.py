"""Where intermediate tables go.

Long lineages are cut by writing a Parquet table below ``spark.checkpoint.dir``, the folder that the
driver and all executors share; a lost executor then costs a re-read instead of a recomputation.
Only when that setting is absent and the master is local (tests, a laptop) is a folder of our own made; on a cluster its absence is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..workers import reachable

_RUN = uuid.uuid4().hex
_OWN: list[str] = []


#: Bytes of rows that go to a Python worker at once (one longer row goes alone): Spark's own limit is 10,000 rows, however long.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Prepare the session for Python workers: they find the package, and get batches of bounded size."""
    reachable(spark)
    spark.conf.set(_LIMIT, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session, else, in local mode only, one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="cubeframe-"))
    return _OWN[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back (lineage cut, survives lost executors)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cubeframe/{_RUN}/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables of this process; results that still read them must have been written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/cubeframe/{_RUN}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
