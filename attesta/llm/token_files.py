"""Token sequences in length-delimited binary files with an offset index.

A file is a run of frames, one a sequence, in ascending doc_id order over all
files (file 0 first)::

    length of the data, 8 bytes | masked checksum of these 8 bytes, 4 bytes
    data: little-endian ids     | masked checksum of the data, 4 bytes

all little-endian.  A checksum is CRC-32 (zlib's; no CRC-32C is at hand that is
fast outside the JVM), masked by a rotation and a constant so that framed
checksums of framed data don't come out as fixed points.  Ids take 2 bytes
where the vocabulary has no more than 65,536, else 4; the index says which.

The index is a Parquet table beside the files: doc_id, file, ordinal in the
file, offset and length of the data, number of ids, and ids before it in the
file.  A file is written under a name of its own for each attempt and the
index names only those of the attempts that Spark committed, so retries and
speculative tasks leave no trace in it.  Reads in any order seek by offset.

Defined results: null and empty texts are sequences of the end id alone; rows
without a doc_id come first; equal doc_ids are in the order of a hash of their
text, within a file also of the text; repeated rows are sequences of their own;
further columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.arrowtools import frees, small_batches, text_runs
from attesta.llm.memo import ONE_WORD, Memo, gather

#: Fixed values of the public TFRecord mask.
_MASK_DELTA = 0xA282EAD8
_INDEX = "doc_id long, file string, ordinal long, offset long, length long, n_tokens long, tokens_before long, id_bytes int, part int"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17 & 0xFFFFFFFF) + _MASK_DELTA) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    head = len(data).to_bytes(8, "little")
    return b"".join((head, masked(head).to_bytes(4, "little"), data, masked(data).to_bytes(4, "little")))


def unframe(file, offset: int, length: int) -> bytes:  # noqa: ANN001
    """The data of a frame whose data starts at ``offset``; raises ValueError if any of it is damaged."""
    file.seek(offset - 12)
    raw = file.read(length + 16)
    head, data = raw[:8], raw[12:-4]
    whole = len(raw) == length + 16 and int.from_bytes(head, "little") == length
    if not whole or masked(head) != int.from_bytes(raw[8:12], "little") or masked(data) != int.from_bytes(raw[-4:], "little"):
        raise ValueError(f"damaged frame at offset {offset - 12}")
    return data


class Tokenizer:
    """A vocabulary file of the tokenizers library.

    Strings of special tokens in a text become those tokens, as the library
    does by default, or are ordinary text with ``plain_specials``.  Chunks are
    encoded on their own where the vocabulary splits text as ``PATTERN`` does
    and a text holds no such string; other texts are encoded in whole.
    """

    def __init__(self, path: str, plain_specials: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain_specials
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        said = json.loads(self.library.to_str())
        self.specials = [t["content"] for t in said.get("added_tokens", ()) if not (plain_specials and t["special"])]
        cut = said.get("pre_tokenizer") or {}
        independent = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and said.get("normalizer") is None
        # The first is the vocabulary's own; the second leaves its pattern out, for chunks that are one match of it.
        split, level = tokenizers.pre_tokenizers.Split, tokenizers.pre_tokenizers.ByteLevel
        self.pattern = self.library.pre_tokenizer
        self.lines = tokenizers.pre_tokenizers.Sequence([split("\n", "isolated"), level(add_prefix_space=False, use_regex=False)])
        self.line_feed = self.library.encode("\n", add_special_tokens=False).ids
        self.memo = Memo(self._encode) if independent and len(self.line_feed) == 1 else None

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *each]), np.array([len(x) for x in each], np.int64)

    def _encode(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each chunk.  Single words are encoded by the thousand in one text, a line feed between them, which is a token of its own."""
        is_word = pc.match_substring_regex(chunks, ONE_WORD)
        words, which = chunks.filter(is_word), is_word.to_numpy(zero_copy_only=False)
        flat, first, sizes, at = [], np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64), 0
        starts, counts = [], []
        self.library.pre_tokenizer = self.lines
        for lo in range(0, len(words), 1000):
            text = "\n".join(words.slice(lo, 1000).to_pylist())
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            edges = np.concatenate([[-1], np.flatnonzero(ids == self.line_feed[0]), [len(ids)]])
            starts.append(at + edges[:-1] + 1)
            counts.append(np.diff(edges) - 1)
            flat.append(ids)
            at += len(ids)
        self.library.pre_tokenizer = self.pattern
        none = [np.zeros(0, np.int64)]
        first[which], sizes[which] = np.concatenate(none + starts), np.concatenate(none + counts)
        ids, n = self._batch(chunks.filter(pa.array(~which)).to_pylist())
        first[~which], sizes[~which] = at + np.cumsum(n) - n, n
        ids, _ = gather(np.concatenate([*flat, ids]), first, sizes, np.arange(len(chunks)))
        return ids, sizes

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and the number of ids before each text and after the last; null is empty."""
        texts = texts.fill_null("")
        special = np.zeros(len(texts), bool)
        for s in self.specials:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if self.memo is not None and not special.any():
            return self.memo.texts(texts)
        rows: list[np.ndarray] = []
        for i in range(len(texts)):
            if self.memo is not None and not special[i]:
                rows.append(self.memo.texts(texts.slice(i, 1))[0])
            else:
                rows.append(self._batch([texts[i].as_py()])[0])
        return np.concatenate([np.zeros(0, np.uint32), *rows]), np.cumsum([0, *map(len, rows)])


@lru_cache(4)
def tokenizer(path: str, plain_specials: bool = False) -> Tokenizer:
    return Tokenizer(path, plain_specials)


def write(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_bytes: int | None = None, partitions: int | None = None, plain_specials: bool = False
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files under ``folder``; returns the index, which is stored there too.

    Ids take ``id_bytes`` bytes (2 or 4), by default what the vocabulary needs; an id that doesn't fit is an error.
    """
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    most = max(tokenizer(vocabulary, plain_specials).size - 1, end_id)
    id_bytes = id_bytes or (2 if most < 1 << 16 else 4)
    if end_id < 0 or most >= 1 << 8 * id_bytes:
        raise ValueError(f"ids up to {most} don't fit into {id_bytes} bytes")
    n = partitions or max(1, docs.rdd.getNumPartitions())
    # Equal doc_ids may span files; rows that are equal altogether are spread by their place, which tells nothing else apart.
    placed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"))
    ordered = placed.repartitionByRange(n, "doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"tokens-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        where, at = pyarrow.fs.FileSystem.from_uri(f"{folder}/{name}")
        where.create_dir(os.path.dirname(at), recursive=True)
        encode = tokenizer(vocabulary, plain_specials).texts
        end = np.array([end_id], "<u4")
        dtype = {2: "<u2", 4: "<u4"}[id_bytes]
        offset = ordinal = before = 0
        with where.open_output_stream(at) as out:
            for batch in batches:
                for first, m in text_runs(batch.column(1)):
                    part = batch.slice(first, m)
                    flat, bounds = encode(part.column(1))
                    rows = []
                    for lo, hi in zip(bounds.tolist(), bounds[1:].tolist()):
                        data = np.concatenate([flat[lo:hi], end]).astype(dtype).tobytes()
                        out.write(frame(data))
                        rows.append((offset + 12, len(data), hi - lo + 1, before, ordinal))
                        offset, before, ordinal = offset + len(data) + 16, before + hi - lo + 1, ordinal + 1
                    at_, length, count, ahead, number = (pa.array(x, pa.int64()) for x in zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array([name] * m), number, at_, length, count, ahead, pa.array([id_bytes] * m, pa.int32()), pa.array([task.partitionId()] * m, pa.int32())],
                        names=["doc_id", "file", "ordinal", "offset", "length", "n_tokens", "tokens_before", "id_bytes", "part"],
                    )

    ordered.mapInArrow(frees(run, "token_files", lambda: tokenizer.cache_clear()), _INDEX).write.option("compression", "zstd").parquet(f"{folder}/index")
    return index(spark, folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(f"{folder}/index")


def starts(indexed: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all sequences before, over all files."""
    from pyspark.sql import Window

    sizes = indexed.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("part", ahead.alias("base"))
    return indexed.join(bases, "part").withColumn("start", F.col("base") + F.col("tokens_before")).drop("base")


def read(indexed: DataFrame, folder: str, packed: bool = False) -> DataFrame:
    """``indexed`` with ``ids`` (array<int>), read from the files by offset and checked against both checksums.

    With ``packed``, ids are binary instead: little-endian unsigned 32-bit integers, end to end.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in indexed.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, file = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for lo in range(0, table.num_rows, 500):
                part = table.slice(lo, 500).combine_chunks()
                found = []
                for name, offset, length, width in zip(*(part.column(c).to_pylist() for c in ("file", "offset", "length", "id_bytes"))):
                    if name != opened:
                        if file is not None:
                            file.close()
                        where, at = pyarrow.fs.FileSystem.from_uri(f"{folder}/{name}")
                        opened, file = name, where.open_input_file(at)
                    found.append(np.frombuffer(unframe(file, offset, length), {2: "<u2", 4: "<u4"}[width]).astype("<u4"))
                if packed:
                    ids = pa.array([x.tobytes() for x in found], pa.binary())
                else:
                    bounds = np.cumsum([0, *map(len, found)]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(found).view(np.int32)))
                yield from part.append_column("ids", ids).to_batches()
        if file is not None:
            file.close()

    return indexed.mapInArrow(frees(run), f"{fields}, ids {'binary' if packed else 'array<int>'}")
