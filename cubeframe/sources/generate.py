"""Synthetic fragments, made where they are needed: every value follows from the seed, the row key and the position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import TYPES, running


def _uniform(key: Column, place: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash, the same on every run and partitioning."""
    return F.pmod(F.xxhash64(key, place, F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52)


def random_fragment(spark: SparkSession, nrows: int, array_len: int, measure_type: str = "double", algorithm: str = "default", row_start: int = 1, seed: int = 0) -> DataFrame:
    """``nrows`` rows from key ``row_start`` on with ``array_len`` elements each.

    ``default``: uniform in 0 to 1000. ``temperatures``: a first-order autoregression, 0.9 of the element before and 0.1 of a uniform number in -5 to
    35, the first uniform. Whole-number types take the ceiling; bit is true for the upper half.
    """
    kind = TYPES.get(measure_type.lower().rsplit("_", 1)[-1])
    if kind is None or min(nrows, array_len, row_start) <= 0:
        raise ValueError("measure_type must be known, and nrows, array_len and row_start positive")
    rows = spark.range(row_start, row_start + nrows).withColumnRenamed("id", "id_dim")
    places = F.sequence(F.lit(1), F.lit(array_len))
    if algorithm == "default":
        values = F.transform(places, lambda p: _uniform(F.col("id_dim"), p, seed) * (127 if kind == "tinyint" else 1000))
    elif algorithm == "temperatures":
        steps = F.transform(places, lambda p: (_uniform(F.col("id_dim"), p, seed) * 40 - 5) * F.when(p == 1, 1.0).otherwise(0.1))
        values = running(steps, 0.9)
    else:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    if kind == "boolean":
        half = 500 if algorithm == "default" else 15
        return rows.select("id_dim", F.transform(values, lambda x: x >= half).alias("measure"))
    if kind not in ("double", "float"):
        values = F.transform(values, lambda x: F.ceil(x))
    return rows.select("id_dim", values.cast(f"array<{kind}>").alias("measure"))
