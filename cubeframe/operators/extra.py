"""Operations beyond the array engine's own: set operations, existence joins, as-of joins, row windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .select import KEY


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def members(rows: DataFrame, other: DataFrame, key: str = KEY) -> DataFrame:
    """The rows whose key the other has."""
    return rows.join(other.select(key), key, "left_semi")


def strangers(rows: DataFrame, other: DataFrame, key: str = KEY) -> DataFrame:
    """The rows whose key the other lacks."""
    return rows.join(other.select(key), key, "left_anti")


def asof(left: DataFrame, right: DataFrame, on: str, by: str, value: str) -> DataFrame:
    """Each left row with the right side's latest ``value`` at or before its ``on``, within ``by``.

    Both sides are put in one sequence per ``by`` and the last value is carried along, so the work is one sort rather than a join on a range.
    """
    a = left.withColumn("_cf_side", F.lit(1)).withColumn(f"_cf_{value}", F.lit(None).cast(dict(right.dtypes)[value]))
    b = right.select(by, on, F.col(value).alias(f"_cf_{value}"), F.lit(0).alias("_cf_side"))
    rows = a.unionByName(b, allowMissingColumns=True)
    before = Window.partitionBy(by).orderBy(on, "_cf_side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(f"{value}_asof", F.last(f"_cf_{value}", ignorenulls=True).over(before)).where("_cf_side = 1").drop("_cf_side", f"_cf_{value}")


def running(rows: DataFrame, value: str, by: str, order: str, out: str = "running") -> DataFrame:
    """The running sum of a value within ``by``."""
    return rows.withColumn(out, F.sum(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
