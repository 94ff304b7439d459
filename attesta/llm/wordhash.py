"""Vectorised word and window hashing of whole Arrow string columns.

A word is a maximal run of bytes other than ``0x20`` and ``0x09``-``0x0D``.
Every function works on all rows of a block at once with numpy, so no Python
code runs per word.  ``blocks`` cuts a column into runs of whole rows of about
``max_bytes``; a longer row forms a block of its own.  Null rows count as
empty texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are not part of a run of letters, ASCII ones or any beyond.
NO_LETTER = np.ones(256, dtype=bool)
NO_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (the public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    """Whole rows ``first`` to ``first + n_rows`` of a column: their bytes and each row's bounds."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def n_rows(self) -> int:
        return len(self.bounds) - 1


def blocks(column: pa.Array | pa.ChunkedArray, max_bytes: int = 1 << 19) -> Iterator[Block]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, n + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1
        last = min(n, max(last, first + 1))
        yield Block(first, whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


@dataclass
class Words:
    """The words of a block: byte bounds, the row of each, and where each row's words begin."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    bounds: np.ndarray

    @property
    def per_row(self) -> np.ndarray:
        return np.diff(self.bounds)


def words(block: Block, outside: np.ndarray = _SPACE) -> Words:
    """The maximal runs of bytes that ``outside`` doesn't mark, within rows."""
    n = len(block.data)
    inside = np.zeros(n + 2, bool)
    np.logical_not(outside[block.data], out=inside[1 : n + 1])
    starts = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    cuts = block.bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    joined = cuts[inside[cuts] & inside[cuts + 1]]  # a word that would run from one row into the next
    starts[joined] = True
    ends[joined] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    bounds = np.searchsorted(start, block.bounds)
    row = np.repeat(np.arange(block.n_rows), np.diff(bounds))
    return Words(start, end, row, bounds)


def hasher(block: Block, lower: bool = False) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function from bounds of byte spans to their 64-bit hashes, equal for equal bytes wherever they stand.

    Eight bytes at a time are scrambled together with their place in the span;
    the sum of these, with the length, is scrambled again.
    """
    n = len(block.data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = _LOWER[block.data] if lower else block.data
    eights = np.ndarray((n + 1,), "<u8", padded, strides=(1,))

    def of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        count = (size + 7) >> 3
        upto = np.cumsum(count)
        place = np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - count, count)
        part = eights[np.repeat(start, count) + 8 * place]
        left = np.repeat(size, count) - 8 * place
        last = np.flatnonzero(left < 8)
        part[last] &= (np.uint64(1) << (8 * left[last]).astype(np.uint64)) - np.uint64(1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(mix(part ^ mix((place.astype(np.uint64) + np.uint64(1)) * _STEP)), out=total[1:])
        return mix(total[upto] - total[upto - count] + size.astype(np.uint64) * _STEP)

    return of


def span_hashes(block: Block, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    return hasher(block, lower)(start, end)


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a row, in order, and each row's bounds among them.

    With ``short``, a row with some but fewer words gets one run of all of them.
    """
    n = len(hashes)
    counts = np.diff(bounds)
    full = np.maximum(counts - size + 1, 0)
    made = np.where((counts > 0) & (counts < size), 1, full) if short else full
    out_bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(made, out=out_bounds[1:])
    out = np.empty(out_bounds[-1], np.uint64)
    rolled = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size if len(rolled) else 0):
        rolled = mix(rolled * _STEP + hashes[k : n - size + 1 + k])
    first = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(full)[:-1]]), full) + np.arange(full.sum())
    is_full = np.repeat(counts >= size, made)
    out[is_full] = rolled[first]
    if short:
        for i in np.flatnonzero((counts > 0) & (counts < size)):
            h = np.full(1, counts[i], np.uint64)
            for w in hashes[bounds[i] : bounds[i + 1]]:
                h = mix(h * _STEP + w)
            out[out_bounds[i]] = h[0]
    return out, out_bounds


def distinct_per_row(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and the new bounds."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[keep], row[keep]
    return values, np.searchsorted(row, np.arange(len(bounds)))
