"""Variables of NetCDF classic files (CDF-1, CDF-2, CDF-5) as long tables.

Files are read as binary rows by Spark (so from any store it reads), a task per file; a file must be below 2 GB, Spark's limit for a cell.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..workers import reachable

#: Element types by number (fixed values of the format).
_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}


class _Header:
    def __init__(self, data: bytes):
        self.data, self.at = data, 4
        if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
            raise ValueError("not a NetCDF classic file")
        self.wide, self.far = data[3] == 5, data[3] != 1
        self.records = self.count()
        self.dims = self.several(lambda: (self.name(), self.count()))
        self.attributes()
        self.variables = dict(self.several(self.variable))

    def number(self, form: str) -> int:
        (value,) = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return value

    def count(self) -> int:
        return self.number(">q" if self.wide else ">i")

    def name(self) -> str:
        n = self.count()
        text = self.data[self.at : self.at + n].decode()
        self.at += -(-n // 4) * 4
        return text

    def several(self, one) -> list:
        self.number(">i")
        return [one() for _ in range(self.count())]

    def attributes(self) -> None:
        def one() -> None:
            self.name()
            kind, n = self.number(">i"), self.count()
            self.at += -(-n * np.dtype(_TYPES[kind]).itemsize // 4) * 4

        self.several(one)

    def variable(self) -> tuple[str, tuple]:
        name = self.name()
        dims = [self.count() for _ in range(self.count())]
        self.attributes()
        kind, size = self.number(">i"), self.count()
        return name, (dims, _TYPES[kind], size, self.number(">q" if self.far else ">i"))


def variable(data: bytes, name: str) -> tuple[list[str], np.ndarray]:
    """The dimension names and the values of a variable in a file's bytes."""
    h = _Header(data)
    if name not in h.variables:
        raise ValueError(f"no variable {name!r}; there are {sorted(h.variables)}")
    dims, kind, _, begin = h.variables[name]
    shape = [h.dims[d][1] for d in dims]
    dtype = np.dtype(kind)
    if dims and shape[0] == 0:
        # Of the record dimension: a record of all such variables after another.
        of_record = [v for v in h.variables.values() if v[0] and h.dims[v[0][0]][1] == 0]
        step = sum(v[2] for v in of_record) if len(of_record) > 1 else int(np.prod(shape[1:], dtype=int)) * dtype.itemsize
        one = int(np.prod(shape[1:], dtype=int))
        values = np.stack([np.frombuffer(data, dtype, one, begin + r * step) for r in range(h.records)]) if h.records else np.zeros((0, one), dtype)
        return [h.dims[d][0] for d in dims], values.reshape([h.records, *shape[1:]])
    return [h.dims[d][0] for d in dims], np.frombuffer(data, dtype, int(np.prod(shape, dtype=int)), begin).reshape(shape)


def read_variable(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A row per value: an int column of 0-based indices per dimension, and the value as a double under the variable's name."""
    reachable(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    dims, _ = variable(bytes(files.first()["content"]), name)
    schema = ", ".join([*[f"`{d}` int" for d in dims], f"`{name}` double"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                _, values = variable(bytes(content), name)
                flat = values.reshape(-1)
                for start in range(0, len(flat), 1 << 20):
                    at = np.unravel_index(np.arange(start, min(len(flat), start + (1 << 20))), values.shape)
                    yield pd.DataFrame({d: i.astype(np.int32) for d, i in zip(dims, at, strict=True)} | {name: flat[start : start + (1 << 20)].astype(float)})

    return files.mapInPandas(work, schema)
