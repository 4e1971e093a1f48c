"""Word and shingle hashing of whole Arrow string columns with numpy, without a Python string per word.

Every byte maps to a random value; a word's hash is the polynomial sum of its bytes' values, in two rings: modulo 2**64, and modulo
the prime 2**31 - 1, as the first alone has words of 1024 letters that hash alike whatever its base. Both are taken from running sums (multiplied by
the inverse power of the base at the word's start), combined and mixed. A-Z map to the values of a-z, so lower-casing is free. White space is
``[\\x20\\x09-\\x0D]``. Texts are worked on in windows, and powers are a product of two small tables, so nothing that is kept grows with a text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; one longer text is still taken whole.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PRIME = (1 << 31) - 1
_SMALL_BASE = 0x3C6EF372
_SMALL_INVERSE, _SMALL_BITS = pow(_SMALL_BASE, -1, _PRIME), 15
#: Bytes whose running sums are taken at once; powers are those within a window times that of the window.
_WINDOW = 1 << 16
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the splitmix64 one)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, modulus: int) -> np.ndarray:
    """base**0 .. base**(window - 1) by the modulus."""
    key = f"powers{base}"
    if key not in _tables:
        out, one = np.empty(_WINDOW, np.uint64), 1
        for i in range(_WINDOW):
            out[i] = one
            one = one * base % modulus
        _tables[key] = out
    return _tables[key]


def _byte_values(lower: bool) -> np.ndarray:
    """The odd 64-bit values of the bytes; their first ``_SMALL_BITS`` bits, which differ too, are the values in the second ring."""
    key = f"bytes{lower}"
    if key not in _tables:
        random = np.random.Generator(np.random.PCG64(20240229))
        first = random.permutation(np.arange(1, 1 << _SMALL_BITS, dtype=np.uint64))[:256]
        values = first << np.uint64(64 - _SMALL_BITS) | random.integers(0, 1 << 48, 256, dtype=np.uint64) * np.uint64(2) | np.uint64(1)
        if lower:
            values[65:91] = values[97:123]
        _tables[key] = values
    return _tables[key]


def _long_word(own: np.ndarray) -> tuple[int, int]:
    """The sums of a word's byte values, window by window."""
    wide = small = 0
    for first in range(0, len(own), _WINDOW):
        part = own[first : first + _WINDOW]
        wide += int((part * _powers(_BASE, 1 << 64)[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, first, 1 << 64)
        part = part >> np.uint64(64 - _SMALL_BITS)
        small += int((part * _powers(_SMALL_BASE, _PRIME)[: len(part)]).sum(dtype=np.uint64)) * pow(_SMALL_BASE, first, _PRIME)
    return wide % (1 << 64), small % _PRIME


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """The hash of the bytes starts[i] .. ends[i] of each word; words are in order and don't overlap."""
    prime, shift, values = np.uint64(_PRIME), np.uint64(64 - _SMALL_BITS), _byte_values(lower)
    powers, back = _powers(_BASE, 1 << 64), _powers(_INVERSE, 1 << 64)
    small_powers, small_back = _powers(_SMALL_BASE, _PRIME), _powers(_SMALL_INVERSE, _PRIME)
    wide, small = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    most = min(_WINDOW, len(data))
    run, buffer = np.zeros(most + 1, np.uint64), np.empty(most, np.uint64)
    i = 0
    while i < len(starts):
        # A window holds whole words, the first of them at its start; a word longer than a window stands alone.
        first = int(starts[i])
        j = i + int(np.searchsorted(ends[i : i + _WINDOW], first + _WINDOW, "right"))
        if j == i:
            wide[i], small[i] = _long_word(values[data[first : int(ends[i])]])
            i += 1
            continue
        own = values[data[first : int(ends[j - 1])]]
        at, to, n = starts[i:j] - first, ends[i:j] - first, len(own)
        np.multiply(own, powers[:n], out=buffer[:n])
        np.cumsum(buffer[:n], out=run[1 : n + 1])
        wide[i:j] = (run[to] - run[at]) * back[at]
        np.right_shift(own, shift, out=own)
        np.multiply(own, small_powers[:n], out=own)
        np.cumsum(own, out=run[1 : n + 1])  # of 15 + 31 + 16 bits
        small[i:j] = (run[to] - run[at]) % prime * small_back[at] % prime
        i = j
    return mix(wide + small * np.uint64(0xD1B54A32D192ED03))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null as empty) and the n+1 offsets of the texts in them."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], wide, len(column) + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str | int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text (a column by name or place); every row is in one run."""
    if not batch.num_rows:
        return
    _, offsets = flat(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def release() -> None:
    """Hand free memory back to the system: workers live on after their task, and what their allocators hold would add up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def frugal(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches, which releases memory when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


class Words(NamedTuple):
    hashes: np.ndarray
    #: Where each word starts and ends in the batch's bytes.
    starts: np.ndarray
    ends: np.ndarray
    #: The words of text i are bounds[i] .. bounds[i + 1].
    bounds: np.ndarray


def words(column: pa.Array, lower: bool = True) -> Words:
    """All words of all texts."""
    data, offsets = flat(column)
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), empty, empty, np.zeros(len(offsets), np.int64))
    inside = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    opens = np.empty(n, bool)
    opens[0] = True
    np.logical_or(~inside[:-1], first[1:n], out=opens[1:])
    closes = np.empty(n, bool)
    closes[-1] = True
    np.logical_or(~inside[1:], first[1:n], out=closes[:-1])
    starts, ends = np.flatnonzero(inside & opens), np.flatnonzero(inside & closes) + 1
    hashes = _word_hashes(data, starts, ends, lower)
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets))


def _combine(hashes: np.ndarray, width: int) -> np.ndarray:
    total = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for j in range(width):
        total += hashes[j : len(hashes) - width + 1 + j] * np.uint64((0xD6E8FEB86659FD93 * (2 * j + 3) + 2 * width | 1) % 2**64)
    return mix(total)


def shingle_sets(found: Words, width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes: runs of ``width`` words; of a shorter text the whole sequence; of an empty one none."""
    grams = _combine(found.hashes, width)
    bounds = found.bounds.tolist()
    for start, end in zip(bounds, bounds[1:], strict=False):
        n = end - start
        if n >= width:
            yield np.unique(grams[start : end - width + 1])
        elif n:
            yield _combine(found.hashes[start:end], n) ^ np.uint64(n)
        else:
            yield found.hashes[:0]
