"""Byte-level BPE by prefix dynamic programming, and its inverse.

For every prefix of a piece there is just one token that the encoding of that
prefix can end with; the table of these last tokens is all the state there is.
The last token at a position is the one vocabulary entry that ends there and
whose pair with the last token before it is *stable*: encoding the bytes of
the two gives the two back.  So a piece of n bytes takes n short steps, more
bytes are appended without touching what stands, and after an edit the table
is computed anew only until it agrees with the old one over the longest
token's length.

``encode_documents`` and ``decode_documents`` apply this to whole tables.
Defined results: a null or empty text has no ids; repeated rows are encoded
alike; further columns are kept (``ids`` is replaced if it is there already).
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from attesta.llm.arrowtools import frees, small_batches, text_runs
from attesta.llm.memo import ONE_WORD, PATTERN, Memo


class Vocabulary:
    """Token bytes and ranks, with the two tests that the dynamic programme needs."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: Every ending of a token, with the token it is, or -1 if it is none that stands alone.
        self.endings = {b[k:]: -1 for b in ranks for k in range(len(b))}
        self.endings.update((b, i) for b, i in ranks.items() if len(b) == 1 or self.merged(b) == [i])
        self.pairs: dict[tuple[int, int], bool] = {}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)})

    def merged(self, data: bytes) -> list[int]:
        """The definition: join the adjacent pair of least rank, the leftmost first, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def is_stable(self, left: int, right: int) -> bool:
        key = (left, right)
        if key not in self.pairs:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            self.pairs[key] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return self.pairs[key]


def _extend(v: Vocabulary, data: bytes, last: list[int], upto: int) -> None:
    """Adds the entries of ``last`` that are missing for the prefixes of ``data`` of up to ``upto`` bytes."""
    endings, pairs = v.endings.get, v.pairs.get
    for end in range(len(last), upto + 1):
        start = end
        while start:
            start -= 1
            token = endings(data[start:end])
            if token is None:
                start = 0
            elif token >= 0:
                if not start:
                    break
                stable = pairs((last[start], token))
                if stable or stable is None and v.is_stable(last[start], token):
                    break
        else:
            raise ValueError("the vocabulary lacks a byte")
        last.append(token)


class PrefixTable:
    """The last token of every prefix of ``data``."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exactly what encoding the longer data would give; no earlier entry changes."""
        self.data += more
        _extend(self.vocabulary, self.data, self.last, len(self.data))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of bytes start to end; returns the number of entries computed."""
        old_last, shift = self.last, len(new) - (end - start)
        tail = len(self.data) - end
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old_last[: start + 1]
        agreed = done = 0
        for at in range(start + 1, len(self.data) + 1):
            if at > start + len(new) + self.vocabulary.longest and agreed >= self.vocabulary.longest:
                self.last += old_last[at - shift :]
                break
            _extend(self.vocabulary, self.data, self.last, at)
            done += 1
            agreed = agreed + 1 if at > len(self.data) - tail and self.last[-1] == old_last[at - shift] else 0
        return done

    def ids(self) -> list[int]:
        """Read off backwards from the last entry."""
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.bytes_of[self.last[at]])
        return out[::-1]


class Encoder:
    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        #: Chunks are independent under the vocabularies' own pattern; for another one, texts are encoded in whole.
        self.memo = Memo(self._new) if pattern == PATTERN else None

    def _pieces(self, pieces: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of each piece; in sorted order, each starts from the table of the prefix that it shares with the one before."""
        out, table = {}, PrefixTable(self.vocabulary)
        endings = self.vocabulary.endings.get
        for piece in sorted(pieces):
            if (known := endings(piece, -1)) >= 0:
                out[piece] = [known]
                continue
            before, same = table.data, 0
            for x, y in zip(piece, before):
                if x != y:
                    break
                same += 1
            table.data = piece
            del table.last[same + 1 :]
            _extend(self.vocabulary, piece, table.last, len(piece))
            out[piece] = table.ids()
        return out

    def _chunks(self, chunks: pa.Array, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, end to end, and their numbers; ``words`` says which are one piece."""
        cut = [[c.encode()] if w else [p.encode() for p in self.pattern.findall(c)] for c, w in zip(chunks.to_pylist(), words.tolist())]
        ids = self._pieces({p for c in cut for p in c})
        flat = array("I", [i for c in cut for p in c for i in ids[p]])
        return np.frombuffer(flat, np.uint32), np.fromiter((sum(len(ids[p]) for p in c) for c in cut), np.int64, len(cut))

    def _new(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._chunks(chunks, pc.match_substring_regex(chunks, ONE_WORD).to_numpy(zero_copy_only=False))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and the number of ids before each text and after the last."""
        if self.memo is not None:
            return self.memo.texts(texts)
        ids, n = self._chunks(pc.fill_null(texts, ""), np.zeros(len(texts), bool))
        return ids, np.cumsum([0, *n])

    def encode(self, text: str) -> list[int]:
        return self.texts(pa.array([text], pa.string()))[0].tolist()


@lru_cache(4)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    return Encoder(Vocabulary.read(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", keep_memo: bool = True) -> DataFrame:
    """``docs`` with an array column ``ids`` in place of the column ``text``.

    With ``keep_memo``, a worker keeps its memo of chunks for its next task.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text, "ids")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for first, n in text_runs(table.column(text), 2 << 20):
                flat, bounds = e.texts(table.column(text).slice(first, n))
                ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.view(np.int32)))
                part = table.slice(first, n).select(keep).combine_chunks()
                yield from part.append_column("ids", ids).to_batches()
        if not keep_memo and e.memo is not None:
            e.memo.forget()

    return docs.select(*keep, text).mapInArrow(frees(run, "byte_bpe", lambda: encoder.cache_clear()), schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with a binary column ``decoded``: the bytes of its ``ids``."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = encoder(path, pattern).vocabulary
        n = max(v.bytes_of, default=0) + 1
        lengths = np.zeros(n, np.int64)
        for i, b in v.bytes_of.items():
            lengths[i] = len(b)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        pool = np.frombuffer(b"".join(v.bytes_of.get(i, b"") for i in range(n)), np.uint8)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for at in range(0, table.num_rows, 256):
                part = table.slice(at, 256).combine_chunks()
                ids = part.column("ids").combine_chunks()
                ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
                flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                size = lengths[flat]
                ends = np.cumsum(size)
                source = np.repeat(starts[flat] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
                rows = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy())])]
                raw = pool[source]
                decoded = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(rows.astype(np.int64)), pa.py_buffer(raw)])
                yield from part.append_column("decoded", decoded.cast(pa.binary())).to_batches()

    return encoded.drop("decoded").mapInArrow(run, ", ".join([*fields, "decoded binary"]))
