"""Small Arrow helpers shared by the batch operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from attesta.session import let_workers_import


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """From now on, Arrow batches of this session hold no more than ``rows`` rows and about ``size`` bytes, so that long texts don't pile up in memory."""
    let_workers_import(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def release() -> None:
    """Give freed memory back to the system; a Python worker outlives its task and may wait, full, beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_HELD: dict[str, Callable[[], None]] = {}


def hold(owner: str | None, clear: Callable[[], None] | None = None) -> None:
    """What this worker keeps from task to task belongs to ``owner`` from now on: what others kept is cleared."""
    others = [o for o in _HELD if o != owner]
    for other in others:
        _HELD.pop(other)()
    if others:
        release()
    if owner is not None and clear is not None:
        _HELD[owner] = clear


def frees(
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str | None = None, clear: Callable[[], None] | None = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, followed by ``release``; only what ``owner`` keeps stays in the worker meanwhile."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(owner, clear)
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def text_runs(column: pa.Array | pa.ChunkedArray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of runs of about ``most`` bytes of text, or of one row."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy()
    ends = np.cumsum(sizes, dtype=np.int64)
    first = 0
    while first < len(sizes):
        before = ends[first] - sizes[first]
        last = max(int(np.searchsorted(ends, before + most, "right")), first + 1)
        yield first, last - first
        first = last


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """Each row of a C-contiguous 2-d array as one binary value."""
    data = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(data.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """Binary values of one length as the rows of a 2-d array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.dtype(dtype).itemsize * width
    n = len(column)
    if not n:
        return np.zeros((0, width), dtype)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    first = np.frombuffer(at, kind, n + 1, column.offset * np.dtype(kind).itemsize)[0]
    return np.frombuffer(data, np.uint8, n * size, int(first)).view(dtype).reshape(n, width)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal ``keys`` of a stream sorted by them.

    Only the run at hand and the batch at hand are in memory.
    """
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        n = table.num_rows
        if not n:
            continue
        changed = np.zeros(n, bool)
        for k in keys:
            c = table.column(k).combine_chunks()
            c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
            if n > 1:
                changed[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        first = tuple(table.column(k)[0].as_py() for k in keys)
        cuts = np.flatnonzero(changed).tolist()
        if held and first != last:
            yield pa.concat_tables(held)
            held = []
        for lo, hi in zip([0, *cuts], [*cuts, n]):
            if lo and held:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(lo, hi - lo))
        last = tuple(table.column(k)[n - 1].as_py() for k in keys)
    if held:
        yield pa.concat_tables(held)
