"""Aggregation of arrays across the rows of a group, position by position.

Rows are taken apart into (group, position, value), so that each position is aggregated by Spark's partial and final aggregates and no group is
ever gathered as arrays; the result is put together once, an array of the cell's length per group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPERATORS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "avg": F.avg, "mean": F.avg, "max": F.max, "min": F.min, "count": F.count, "std": F.stddev_samp, "sd": F.stddev_samp, "var": F.var_samp, "product": F.product,
}


def _rebuilt(rows: DataFrame, keys: list[str], value: str = "v", out: str = "measure") -> DataFrame:
    """One array per group of (keys, pos, value), in the order of pos."""
    cells = F.array_sort(F.collect_list(F.struct(F.col("pos"), F.col(value).alias("v"))))
    return rows.groupBy(*keys).agg(F.transform(cells, lambda s: s["v"]).alias(out))


def aggregate_operator(rows: DataFrame, keys: list[str], operator: str = "sum", measure: str = "measure") -> DataFrame:
    """keys and measure: the operator over the rows of each group, per position."""
    work = OPERATORS[operator.lower().rsplit("_", 1)[-1]]
    long = rows.select(*keys, F.posexplode(measure).alias("pos", "x"))
    return _rebuilt(long.groupBy(*keys, "pos").agg(work("x").cast("double").alias("v")), keys, out=measure)


def aggregate_fixed(rows: DataFrame, keys: list[str], operator: str, length: int, measure: str = "measure") -> DataFrame:
    """As ``aggregate_operator`` for cells of a known length: an aggregate per position, without taking the rows apart."""
    work = OPERATORS[operator.lower().rsplit("_", 1)[-1]]
    return rows.groupBy(*keys).agg(F.array(*[work(F.get(measure, F.lit(i))).cast("double") for i in range(length)]).alias(measure))


def partial_state(x: Column) -> dict[str, Column]:
    """The mergeable state of values, as aggregates."""
    return {"n": F.count(x), "s": F.sum(x), "mean": F.avg(x), "m2": F.var_pop(x) * F.count(x), "low": F.min(x), "high": F.max(x)}


def full_stats(x: Column) -> dict[str, Column]:
    """Count, sum, mean, standard deviation (of a sample) and extremes of values, as aggregates."""
    return {"count": F.count(x), "sum": F.sum(x), "avg": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x)}


def stats_partial(rows: DataFrame, keys: list[str], measure: str = "measure") -> DataFrame:
    """keys, pos and the mergeable state of each position: count, sum, mean, sum of squared distances from the mean, extremes."""
    long = rows.select(*keys, F.posexplode(measure).alias("pos", "x"))
    return long.groupBy(*keys, "pos").agg(*[c.alias(n) for n, c in partial_state(F.col("x")).items()])


def stats_final(partial: DataFrame, keys: list[str]) -> DataFrame:
    """Merges states of the same (keys, pos) and finishes them: count, sum, avg, std, min, max."""
    # The states' means are compared with the whole mean, so that nothing large is subtracted; both passes have the same partitions.
    own = Window.partitionBy(*keys, "pos")
    moved = partial.withColumn("_cf_off", F.col("mean") - F.try_divide(F.sum("s").over(own), F.sum("n").over(own)))
    merged = moved.groupBy(*keys, "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("m2") + F.col("n") * F.col("_cf_off") * F.col("_cf_off")).alias("m2"), F.min("low").alias("low"), F.max("high").alias("high"))
    variance = F.try_divide("m2", F.col("n") - 1)
    return merged.select(*keys, "pos", F.col("n").alias("count"), F.col("s").alias("sum"), F.try_divide("s", "n").alias("avg"), F.sqrt(variance).alias("std"), F.col("low").alias("min"), F.col("high").alias("max"))


def aggregate_stats(rows: DataFrame, keys: list[str], measure: str = "measure") -> DataFrame:
    """keys, pos, count, sum, avg, std, min, max of each position over the rows of a group."""
    long = rows.select(*keys, F.posexplode(measure).alias("pos", "x"))
    return long.groupBy(*keys, "pos").agg(*[c.alias(n) for n, c in full_stats(F.col("x")).items()])


def in_order(cells: Column, order: Column, *_: object) -> Column:
    """An aggregate: the arrays of a group by the order, end to end."""
    sorted_ = F.array_sort(F.collect_list(F.struct(order.alias("k"), cells.alias("m"))))
    return F.flatten(F.transform(sorted_, lambda s: s["m"]))


def roll_up(rows: DataFrame, keys: list[str], order: str = "id_dim", measure: str = "measure") -> DataFrame:
    """The arrays of a group's rows, in the order of ``order``, as one array (which a row must be able to hold)."""
    return rows.groupBy(*keys).agg(in_order(F.col(measure), F.col(order)).alias(measure))
