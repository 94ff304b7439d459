"""Text cut into chunks that a byte-level BPE vocabulary encodes independently, and a memo of their ids.

The vocabularies' pattern (``PATTERN``; no other is accepted) never joins a
character that is white space with a following one that isn't, but for one
space before a word.  So a text cut by ``CHUNK`` (white space as Unicode
defines it) gives the same ids chunk by chunk as in whole, and a chunk that has
been met before needs no new work.  A mark at a chunk's end that follows a
letter or digit is encoded by itself too, so a word is encoded once whatever
mark follows it.  Texts whose white space is single spaces and line feeds are
cut, and their chunks told apart, by Arrow's kernels a block at a time; Python
code runs for the distinct chunks of a block only.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the pattern of the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_WHITE = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
CHUNK = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_UNUSUAL = "[" + _WHITE.replace(" ", "", 1).replace("\n", "") + "]|  |\n\n| \n|\n "
_SPACES = frozenset(_WHITE) | {""}
#: Letters of the Latin blocks: they are letters in every version of Unicode in use.
_LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha())
_MARKED = f"[{_LETTERS}0-9][.,;:!?]$"
#: Whether chunks, but for their leading space, are Latin letters alone, and so one match of the pattern.
ONE_WORD = f"^ ?[{_LETTERS}]+$"


def gather(pool: np.ndarray, first: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``pool`` that ``codes`` name, end to end, and how much lies before each and after the last."""
    own = sizes[codes]
    bounds = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(own, out=bounds[1:])
    source = np.repeat(first[codes] - bounds[:-1], own)
    source += np.arange(bounds[-1])
    return pool[source], bounds


def _plain_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.fill_null("") if column.null_count else column


class Memo:
    """Ids of texts, as 32-bit integers, by way of ``encode`` for chunks not at hand.

    ``encode`` takes distinct chunks and gives their ids, end to end, and the
    number of each one's.  The memo holds up to ``entries`` chunks of no more
    than ``longest`` characters, and of more it forgets the half that was used
    least recently, so its memory is bounded; results don't depend on it.  A
    chunk's key is what follows its leading space; a carriage return precedes
    the keys of other chunks.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], entries: int = 400_000, longest: int = 48) -> None:
        self.encode, self.entries, self.longest = encode, entries, longest
        self.forget()

    def forget(self) -> None:
        self.keys, self.pool = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.first = self.sizes = self.used = np.zeros(0, np.int64)
        self.now = 0

    def _runs(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, first, sizes) of some distinct keys; new ones are encoded and remembered."""
        self.now += 1
        at = pc.fill_null(pc.index_in(keys, value_set=self.keys), -1).to_numpy().astype(np.int64)
        known = at >= 0
        self.used[at[known]] = self.now
        new = keys.filter(pa.array(~known))
        chunks = pc.if_else(pc.starts_with(new, "\r"), pc.utf8_slice_codeunits(new, 1), pc.binary_join_element_wise(" ", new, ""))
        ids, n = self.encode(chunks) if len(new) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        begin = np.cumsum(n) - n + len(self.pool)
        pool = np.concatenate([self.pool, ids.astype(np.uint32, copy=False)])
        first, sizes = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        first[known], sizes[known] = self.first[at[known]], self.sizes[at[known]]
        first[~known], sizes[~known] = begin, n
        short = pc.less_equal(pc.utf8_length(new), self.longest).to_numpy(zero_copy_only=False)
        self.keys = pa.concat_arrays([self.keys, new.filter(pa.array(short))])
        self.first, self.sizes = np.concatenate([self.first, begin[short]]), np.concatenate([self.sizes, n[short]])
        self.used = np.concatenate([self.used, np.full(short.sum(), self.now)])
        self.pool = pool
        if len(self.keys) > self.entries or not short.all():
            keep = np.arange(len(self.keys))
            if len(keep) > self.entries:
                keep = np.sort(np.argpartition(-self.used, self.entries // 2)[: self.entries // 2])
            self.keys, self.used = self.keys.take(pa.array(keep)), self.used[keep]
            self.pool, bounds = gather(pool, self.first, self.sizes, keep)
            self.first, self.sizes = bounds[:-1], np.diff(bounds)
        return pool, first, sizes

    def _ids(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all keys, end to end, and the number of ids before each key and after the last."""
        coded = keys.dictionary_encode()
        distinct = coded.dictionary
        marked = pc.match_substring_regex(distinct, _MARKED).to_numpy(zero_copy_only=False)
        word = pc.if_else(pa.array(marked), pc.utf8_slice_codeunits(distinct, 0, -1), distinct)
        mark = pc.binary_join_element_wise("\r", pc.utf8_slice_codeunits(distinct.filter(pa.array(marked)), -1), "")
        parts = pa.concat_arrays([word, mark]).dictionary_encode()
        codes = parts.indices.to_numpy()
        # Of each distinct key the part before its mark, then the mark if it has one.
        places = np.cumsum(1 + marked) - 1 - marked
        each = np.empty(len(codes), np.int64)
        each[places] = codes[: len(distinct)]
        each[places[marked] + 1] = codes[len(distinct) :]
        flat, bounds = gather(*self._runs(parts.dictionary), each)
        first = bounds[places]
        return gather(flat, first, bounds[places + 1 + marked] - first, coded.indices.to_numpy())

    def _usual(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.binary_join_element_wise("\r", pc.replace_substring(texts, "\n", " \r\n \r"), "")
        cut = pc.split_pattern(marked, " ")
        ids, bounds = self._ids(cut.flatten())
        offsets = cut.offsets.to_numpy()
        return ids, bounds[offsets - offsets[0]]

    def _other(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = [CHUNK.findall(t) for t in texts.to_pylist()]
        keys = [c[1:] if c[:1] == " " and c[1:2] not in _SPACES else "\r" + c for chunks in cut for c in chunks]
        ids, bounds = self._ids(pa.array(keys, pa.string()))
        return ids, bounds[np.cumsum([0, *map(len, cut)])]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and the number of ids before each text and after the last; null is empty."""
        texts = _plain_array(texts)
        unusual = pc.match_substring_regex(texts, _UNUSUAL).to_numpy(zero_copy_only=False)
        if not unusual.any():
            return self._usual(texts)
        usual_ids, usual = self._usual(texts.filter(pa.array(~unusual)))
        other_ids, other = self._other(texts.filter(pa.array(unusual)))
        first, sizes = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        first[~unusual], sizes[~unusual] = usual[:-1], np.diff(usual)
        first[unusual], sizes[unusual] = other[:-1] + len(usual_ids), np.diff(other)
        return gather(np.concatenate([usual_ids, other_ids]), first, sizes, np.arange(len(texts)))
