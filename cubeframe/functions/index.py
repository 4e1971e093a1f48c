"""Index arithmetic on the row key: 1-based ids that linearise the explicit dimensions, the last one fastest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _long(x: Column | int) -> Column:
    return x.cast("long") if isinstance(x, Column) else F.lit(int(x)).cast("long")


def _div(a: Column, b: Column) -> Column:
    """Division of integers that truncates, in whole numbers throughout."""
    return F.call_function("div", a, b)


def block_id(key: Column, size: Column | int) -> Column:
    """The 1-based number of the block of ``size`` ids that holds the key."""
    return _div(_long(key) - 1, _long(size)) + 1


def block_id2(key: Column, size: Column | int, block: Column | int) -> Column:
    """The key after each run of ``size`` blocks of ``block`` ids is folded to one block."""
    key, size, block = _long(key), _long(size), _long(block)
    return (key - 1) % block + 1 + _div(key - 1, size * block) * block


def block_id3(key: Column, sizes: Column, block: Column | int) -> Column:
    """The key with groups of given sizes (in blocks of ``block`` ids, repeating) folded to one block each."""
    key, block = _long(key), _long(block)
    sizes = F.transform(sizes, lambda s: s.cast("long"))
    zero = F.lit(0).cast("long")
    period = F.aggregate(sizes, zero, lambda a, s: a + s)
    place = _div(key - 1, block)
    inside = place % period
    start = F.struct(zero.alias("end"), zero.alias("group"))
    group = F.aggregate(sizes, start, lambda a, s: F.struct((a["end"] + s).alias("end"), (a["group"] + F.when(inside >= a["end"] + s, 1).otherwise(0)).cast("long").alias("group")), lambda a: a["group"])
    return (key - 1) % block + (group + _div(place, period) * F.size(sizes)) * block + 1


def id_to_index(key: Column, *sizes: Column | int) -> Column:
    """The 1-based coordinate of the key along the last listed dimension; dimensions are listed from the fastest. -1 below 1."""
    if not sizes:
        raise ValueError("id_to_index needs a key and a dimension size at least")
    key, last = _long(key), _long(sizes[-1])
    before = reduce(lambda a, b: a * b, [_long(s) for s in sizes[:-1]], F.lit(1).cast("long"))
    return F.when(key < 1, F.lit(-1).cast("long")).otherwise(_div(key - 1, before) % last + 1)


def id_to_index2(key: Column, block: Column | int, size: Column | int) -> Column:
    """The 1-based coordinate along a dimension of ``size`` values, each ``block`` ids long."""
    return _div(_long(key) - 1, _long(block)) % _long(size) + 1


def is_in_subset(key: Column, start: Column | int, step: Column | int, stop: Column | int) -> Column:
    """1 if the key is one of start, start + step, ... up to stop, else 0."""
    key, start = _long(key), _long(start)
    return (((key - start) % _long(step) == 0) & key.between(start, _long(stop))).cast("long")


def id_of_subset(key: Column, start: Column | int, step: Column | int, stop: Column | int | None = None) -> Column:
    """The 1-based place of a member in the subset start:step:stop, null for others."""
    key = _long(key)
    member = (key >= _long(start)) & ((key - _long(start)) % _long(step) == 0)
    if stop is not None:
        member &= key <= _long(stop)
    return F.when(member, _div(key - _long(start), _long(step)) + 1)
