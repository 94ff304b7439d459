"""A Bloom filter of document identifiers, of at most 16 MB.

It only spares rows a shuffle: an exact join follows wherever it is used, so a
filter that is too full costs time and never changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.wordhash import mix

_HASHES, _MAX_BITS = 3, 1 << 27


def _places(ids: pa.Array, bits: int) -> np.ndarray:
    h = mix(ids.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64) + np.uint64(77))
    step = mix(h) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) % np.uint64(bits) for k in range(_HASHES)])


def bloom_filter(ids: DataFrame) -> np.ndarray:
    """Of the column doc_id, with 16 bits a value as long as 16 MB allow; null counts as -1."""
    bits = max(1 << 10, min(_MAX_BITS, 1 << (16 * ids.count()).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _places(b.column(0), bits).ravel()
            word, mask = (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], names=["word", "mask"])

    found = ids.select("doc_id").mapInArrow(places, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return out


def may_hold(bloom: np.ndarray, ids: pa.Array) -> pa.Array:
    """Whether each id may be one of the filter's."""
    p = _places(ids, 64 * len(bloom))
    return pa.array(((bloom[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).all(0))
