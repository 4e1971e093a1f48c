"""Fragments from long tables: explicit dimensions become the row key, implicit ones the places of the array."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dim:
    """A dimension of a cube: a column of 0-based indices, its size, whether it becomes rows, and the subset read (inclusive)."""

    name: str
    size: int
    explicit: bool
    start: int = 0
    end: int | None = None

    @property
    def last(self) -> int:
        return self.size - 1 if self.end is None else self.end

    @property
    def count(self) -> int:
        return self.last - self.start + 1


def check(dims: Sequence[Dim]) -> None:
    if not any(d.explicit for d in dims):
        raise ValueError("a cube needs an explicit dimension")
    for d in dims:
        if not 0 <= d.start <= d.last < d.size:
            raise ValueError(f"bad subset {d.start}..{d.last} of {d.name} with {d.size} values")


def _place(dims: Sequence[Dim]) -> Column:
    """The 0-based row-major place, the last dimension fastest."""
    return reduce(lambda at, d: at * d.count + (F.col(d.name) - d.start), dims, F.lit(0).cast("long"))


def from_long(rows: DataFrame, value: str, dims: Sequence[Dim], fill: float | None = None, row_start: int = 1, nrows: int | None = None, kind: str = "double") -> DataFrame:
    """The fragment (id_dim, measure) of a long table with a column per dimension and a value per row.

    ``dims`` are in the target's nesting order, whatever their order in the table. Subsets become filters on the table, which reach its scan.
    Places without a value get ``fill`` (null without it); rows without any value are absent; of several values of a place the largest counts. ``row_start`` and
    ``nrows`` take a range of row keys.
    """
    check(dims)
    explicit, implicit = [d for d in dims if d.explicit], [d for d in dims if not d.explicit]
    for d in dims:
        if d.start or d.last != d.size - 1:
            rows = rows.where(F.col(d.name).between(d.start, d.last))
    key = _place(explicit) + 1
    if row_start != 1 or nrows is not None:
        rows = rows.where((key >= row_start) & (key < row_start + nrows if nrows is not None else F.lit(True)))
    length = reduce(lambda a, d: a * d.count, implicit, 1)
    cells = rows.select(key.cast("long").alias("id_dim"), _place(implicit).cast("int").alias("pos"), F.col(value).cast(kind).alias("v")).groupBy("id_dim").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("cells"))
    empty = F.lit(fill).cast(kind)

    def part(cell: Column, i: Column) -> Column:
        """The empty places since the cell before, and the cell's value, unless the next cell is of the same place and so larger."""
        before, after = F.get("cells", i - 1)["pos"], F.get("cells", i + 1)["pos"]
        gap = F.array_repeat(empty, cell["pos"] - F.coalesce(before, F.lit(-1)) - 1)
        return F.when(cell["pos"].eqNullSafe(after), gap).otherwise(F.concat(gap, F.array(F.coalesce(cell["v"], empty))))

    tail = F.array_repeat(empty, F.lit(length - 1) - F.element_at("cells", -1)["pos"])
    return cells.select("id_dim", F.concat(F.flatten(F.transform("cells", part)), tail).alias("measure"))


def reduced_at_source(rows: DataFrame, value: str, dims: Sequence[Dim], operator: str = "avg") -> DataFrame:
    """As ``from_long`` with the implicit dimensions reduced to one value, aggregated before any array is built."""
    from ..operators.aggregate import OPERATORS

    check(dims)
    for d in dims:
        if d.start or d.last != d.size - 1:
            rows = rows.where(F.col(d.name).between(d.start, d.last))
    key = (_place([d for d in dims if d.explicit]) + 1).cast("long").alias("id_dim")
    return rows.groupBy(key).agg(F.array(OPERATORS[operator.lower().rsplit("_", 1)[-1]](value).cast("double")).alias("measure"))


def to_long(fragment: DataFrame, dims: Sequence[Dim], value: str = "value") -> DataFrame:
    """A row per place of a fragment, with a column of indices per dimension: undoes ``from_long``."""
    rows = fragment.select("id_dim", F.posexplode("measure").alias("_cf_pos", value))
    out, explicit, implicit = {}, [d for d in dims if d.explicit], [d for d in dims if not d.explicit]
    for group, place in ((explicit, F.col("id_dim") - 1), (implicit, F.col("_cf_pos").cast("long"))):
        rest = place
        for d in reversed(group):
            out[d.name] = (rest % d.count + d.start).cast("int")
            rest = F.call_function("div", rest, F.lit(d.count))
    return rows.select(*[out[d.name].alias(d.name) for d in dims], value)


def concatenated(tables: Sequence[DataFrame], dim: str, sizes: Sequence[int]) -> DataFrame:
    """Long tables of cubes that continue each other along ``dim``: each one's indices move behind those before."""
    out, at = None, 0
    for table, size in zip(tables, sizes, strict=True):
        moved = table.withColumn(dim, F.col(dim) + at)
        out = moved if out is None else out.unionByName(moved)
        at += size
    return out
