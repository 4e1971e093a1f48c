"""The SELECT pipeline on fragments: FROM and join, WHERE, LIMIT, GROUP and project, ORDER, in this order.

The limit comes before grouping and ordering, as this engine defines it; ``top_k`` is the usual other order.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "id_dim"
#: Parts that a range of keys is cut into at once, and the rows of a part beyond which it is cut again.
RANGES, MOST_ROWS = 65536, 1 << 20
#: Rows that a limit takes by a partial sort, offset included.
MOST_TAKEN = 1 << 16


def aligned(*frames: DataFrame, key: str = KEY) -> DataFrame:
    """The inner equi-join of fragments on the row key; Catalyst chooses how."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, key, "inner")
    return out


def limited(rows: DataFrame, count: int, offset: int = 0, key: str | None = KEY) -> DataFrame:
    """``count`` rows (0: all) from the ``offset``-th on, by the row key where there is one.

    Up to ``MOST_TAKEN`` rows are taken by a partial sort; beyond it rows are numbered in parts, and none come to one task.
    """
    if not count and not offset:
        return rows
    if key in rows.columns and offset + count > MOST_TAKEN:
        place = F.col("_cf_place")
        numbered = renumbered(rows.withColumn("_cf_place", F.col(key)), 1, "_cf_place").where(place > offset)
        return (numbered.where(place <= offset + count) if count else numbered).drop("_cf_place")
    rows = rows.orderBy(key) if key in rows.columns else rows
    rows = rows.offset(offset) if offset else rows
    return rows.limit(count) if count else rows


def renumbered(rows: DataFrame, start: int, key: str = KEY) -> DataFrame:
    """Row keys become start, start + 1, ... in their order, without a pass through one task; ``rows`` themselves if none has a key.

    The keys' range is cut into ``RANGES`` equal parts, and a part of more than ``MOST_ROWS`` rows again by its own range, until parts are
    small (unique 64-bit keys need four cuts at most); each part's first number follows from the counts of the parts before (a row per part).
    Rows are computed twice: for their keys, which stay on disk while parts are counted, and for the result. Counts stay cached, as the result reads them.
    """
    keys = rows.select(key).persist(StorageLevel.DISK_ONLY)
    try:
        low, high = keys.agg(F.min(key), F.max(key)).first()
        if low is None:
            return rows
        parts, cuts = ["_cf_part0"], []

        def parted(of: DataFrame) -> DataFrame:
            out = of.withColumn("_cf_part0", F.call_function("div", F.col(key) - low, F.lit(-(-(high - low + 1) // RANGES))))
            for i, ranges in enumerate(cuts, 1):
                cut = F.coalesce(F.call_function("div", F.col(key) - F.col("_cf_low"), F.col("_cf_width")), F.lit(0))
                out = out.join(ranges, parts[:i], "left").withColumn(f"_cf_part{i}", cut).drop("_cf_low", "_cf_width")
            return out

        while True:
            counts = parted(keys).groupBy(*parts).agg(F.count(F.lit(1)).alias("_cf_n"), F.min(key).alias("_cf_low"), F.max(key).alias("_cf_high")).persist()
            large = counts.where((F.col("_cf_n") > MOST_ROWS) & (F.col("_cf_high") > F.col("_cf_low")))
            if not large.count() or len(parts) == 4:
                break
            width = F.call_function("div", F.col("_cf_high") - F.col("_cf_low"), F.lit(RANGES)) + 1
            cuts.append(F.broadcast(large.select(*parts, "_cf_low", width.alias("_cf_width"))))
            parts.append(f"_cf_part{len(parts)}")
    finally:
        keys.unpersist()
    before = Window.orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("_cf_first", F.coalesce(F.sum("_cf_n").over(before), F.lit(0))).select(*parts, "_cf_first")
    own = F.row_number().over(Window.partitionBy(*parts).orderBy(key))
    return parted(rows).join(F.broadcast(first), parts).withColumn(key, (F.col("_cf_first") + own - 1 + start).cast("long")).select(*rows.columns)


def grouped(rows: DataFrame, by: Column, columns: dict[str, Column], simple: dict[str, Column], key: str = KEY, decimals: int | None = None) -> DataFrame:
    """One row per value of ``by``: aggregates, and for plain columns the value of the group's first row, for functions that of its last.

    With ``decimals``, groups of floating-point values are rounded first. Groups are in the order of their first row (column ``_first``).
    """
    by = F.round(by, decimals) if decimals is not None else by
    first = {n: F.min_by(c, key).alias(n) for n, c in columns.items()}
    last = {n: F.max_by(c, key).alias(n) for n, c in simple.items()}
    return rows.groupBy(by.alias("_group")).agg(F.min(key).alias("_first"), *first.values(), *last.values())


def ordered(rows: DataFrame, column: str, descending: bool = False, key: str = KEY) -> DataFrame:
    """By one numeric column; ties by the row key."""
    kind = dict(rows.dtypes).get(column)
    if kind is None:
        raise ValueError(f"unknown column {column!r}")
    if kind == "string" or kind.startswith("array"):
        raise ValueError(f"cannot order by {column!r} of type {kind}")
    first = F.col(column).desc() if descending else F.col(column).asc()
    return rows.orderBy(first, *([key] if key in rows.columns and key != column else []))


def top_k(rows: DataFrame, column: str, k: int, descending: bool = True, key: str = KEY) -> DataFrame:
    """The k rows with the largest (or smallest) values, in order."""
    return ordered(rows, column, descending, key).limit(k)
