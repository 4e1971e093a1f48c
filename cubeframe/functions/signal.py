"""Transforms of array cells that Spark's functions can't express: numpy over Arrow batches.

Cells of equal length in a batch are worked on as one matrix, cut into runs of bounded size; no cell becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..workers import release, ship

COMPLEX = "array<struct<re:double,im:double>>"
#: Elements that ``work`` gets at once (a longer cell goes alone).
MOST_ELEMENTS = 1 << 17


def _doubles(values: pa.Array) -> np.ndarray:
    """Elements as doubles, null as NaN."""
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _elements(x: np.ndarray) -> pa.Array:
    """Doubles as elements, NaN as null."""
    return pa.array(np.ascontiguousarray(x), from_pandas=True)


def _by_length(cells: pa.Array, values: np.ndarray, work: Callable[[np.ndarray], np.ndarray], form: Callable[[np.ndarray], pa.Array] = _elements) -> pa.Array:
    """``work`` on the matrices of cells of a length, whose elements are ``values``, and ``form`` of all results; null cells stay null, empty ones empty."""
    offsets, null = cells.offsets.to_numpy(), cells.is_null().to_numpy(zero_copy_only=False)
    sizes = np.where(null, 0, np.diff(offsets))
    done, lengths = [], np.zeros(len(cells), np.int64)
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        step = max(1, MOST_ELEMENTS // int(size))
        for rows in np.split(at, range(step, len(at), step)):
            results = work(values[offsets[rows][:, None] + np.arange(size)])
            lengths[rows] = results.shape[1]
            done.append((rows, results))
    ends = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.empty(ends[-1], done[0][1].dtype if done else float)
    for rows, results in done:
        flat[ends[rows][:, None] + np.arange(results.shape[1])] = results
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), form(flat), mask=pa.array(null))


def _udf(kind: str, work: Callable[[pa.Array], pa.Array]) -> Callable[[Column], Column]:
    """``work`` on the cells of a batch, as a function of columns."""
    ship()

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for cells in batches:
                yield work(cells)
        finally:
            release()

    return run


def fft(m: Column) -> Column:
    """The discrete Fourier transform of real cells, as complex cells."""

    def form(z: np.ndarray) -> pa.Array:
        return pa.StructArray.from_arrays([_elements(z.real), _elements(z.imag)], ["re", "im"])

    return _udf(COMPLEX, lambda cells: _by_length(cells, _doubles(cells.values), lambda x: np.fft.fft(x, axis=1), form))(m)


def ifft(m: Column) -> Column:
    """The real part of the inverse transform of complex cells."""

    def work(cells: pa.Array) -> pa.Array:
        z = np.empty(len(cells.values), complex)
        z.real, z.imag = (_doubles(pc.struct_field(cells.values, name)) for name in ("re", "im"))
        return _by_length(cells, z, lambda x: np.fft.ifft(x, axis=1).real)

    return _udf("array<double>", work)(m)


def _haar(x: np.ndarray) -> np.ndarray:
    if x.shape[1] & (x.shape[1] - 1):
        raise ValueError("the wavelet transform needs a power of two of elements")
    out, n = x.copy(), x.shape[1]
    while n > 1:
        a, b = out[:, 0:n:2].copy(), out[:, 1:n:2].copy()
        n //= 2
        out[:, :n], out[:, n : 2 * n] = (a + b) / np.sqrt(2), (a - b) / np.sqrt(2)
    return out


def _haar_back(x: np.ndarray) -> np.ndarray:
    if x.shape[1] & (x.shape[1] - 1):
        raise ValueError("the wavelet transform needs a power of two of elements")
    out, n = x.copy(), 1
    while n < x.shape[1]:
        a, b = out[:, :n].copy(), out[:, n : 2 * n].copy()
        out[:, 0 : 2 * n : 2], out[:, 1 : 2 * n : 2] = (a + b) / np.sqrt(2), (a - b) / np.sqrt(2)
        n *= 2
    return out


def _plain(work: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    return _udf("array<double>", lambda cells: _by_length(cells, _doubles(cells.values), work))


def dwt(m: Column) -> Column:
    """The orthonormal Haar wavelet transform: the smooth part first, then details from coarse to fine."""
    return _plain(_haar)(m)


def idwt(m: Column) -> Column:
    return _plain(_haar_back)(m)


def convolve(m: Column, taps: list[float]) -> Column:
    """The causal filter y[i] = sum of taps[k] * x[i - k], x being 0 before the start."""
    kernel = F.array(*[F.lit(float(t)) for t in taps])
    return F.transform(m, lambda _, i: F.aggregate(F.sequence(F.lit(0), F.least(i, F.lit(len(taps) - 1))), F.lit(0.0), lambda a, k: a + F.get(kernel, k) * F.get(m, i - k)))


def spline(m: Column, points: int) -> Column:
    """The natural cubic spline through the elements, at ``points`` places evenly spread from the first to the last."""

    def work(y: np.ndarray) -> np.ndarray:
        n = y.shape[1]
        at = np.linspace(0, n - 1, points)
        if n < 3:
            return np.stack([np.interp(at, np.arange(n), row) for row in y])
        # The tridiagonal system of 1, 4, 1: one sweep forward, one back, for all cells at once.
        second, ratio = np.zeros_like(y), np.zeros(n)
        for i in range(1, n - 1):
            ratio[i] = 1 / (4 - ratio[i - 1])
            second[:, i] = (6 * (y[:, i + 1] - 2 * y[:, i] + y[:, i - 1]) - second[:, i - 1]) * ratio[i]
        for i in range(n - 3, 0, -1):
            second[:, i] -= ratio[i] * second[:, i + 1]
        low = np.minimum(at.astype(int), n - 2)
        b = at - low
        a = 1 - b
        return a * y[:, low] + b * y[:, low + 1] + ((a**3 - a) * second[:, low] + (b**3 - b) * second[:, low + 1]) / 6

    return _plain(work)(m)


def kcluster(m: Column, k: int, rounds: int = 50) -> Column:
    """The cluster (1 to k, by ascending centre) of each element: k-means on the values, started at even quantiles."""

    def work(x: np.ndarray) -> np.ndarray:
        centres = np.quantile(x, (np.arange(k) + 0.5) / k, axis=1).T
        for _ in range(rounds):
            own = np.abs(x[:, :, None] - centres[:, None, :]).argmin(axis=2)
            hot = own[:, :, None] == np.arange(k)
            count = hot.sum(axis=1)
            new = np.where(count > 0, (x[:, :, None] * hot).sum(axis=1) / np.maximum(count, 1), centres)
            if np.allclose(new, centres):
                break
            centres = new
        rank = np.argsort(np.argsort(centres, axis=1), axis=1)
        return (np.take_along_axis(rank, own, axis=1) + 1).astype(float)

    return _plain(work)(m)
