"""Quality by perplexity under an interpolated modified Kneser-Ney model.

The model is one of byte 5-grams per language, trained on trusted text (labels
of quality 1).  Counting is map-side per task, then a shuffle of n-gram counts;
lower orders are the numbers of distinct left extensions, and discounts follow
from the counts of counts of each language and order.  Probabilities of seen
n-grams and back-off weights of contexts are stored as shards of bounded size,
by language, order and key.  Scoring joins the distinct n-grams of a megabyte of
texts with the shards that hold them, a shard at a time, so no task holds the
whole model and no text is shuffled to be scored; a worker keeps the shards it
read last, up to 6 million rows.

A tenth of the trusted documents, by hash, is held out of training; the given
quantile of their perplexities is their language's threshold.  All trusted text
counts, and all held-out documents; nothing is sampled.

Defined results: a null or empty text has no perplexity and is rejected; a
language without trusted held-out text has no threshold, and its documents are
not judged (kept); a null language is one language; of several labels of a
document the worst counts; repeated rows are scored alike; further columns are
kept, but ``perplexity``, ``threshold`` and ``kept`` are replaced; a NUL byte in
a text counts as what stands before its start.  The quantile is approximate: its
rank is within a ten-thousandth of the number of held-out texts.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm import scratch
from attesta.llm.arrowtools import frees, small_batches
from attesta.llm.bloom import bloom_filter, may_hold
from attesta.llm.wordhash import Block, blocks, mix

ORDER = 5
HELD_OUT_IN = 10
SHARD_ROWS = 200_000
#: Kinds of model rows: an n-gram of order o, and the context of one.
_CONTEXT = 10


def _language(c: str = "lang") -> Column:
    """A directory-safe name of a language."""
    return F.coalesce(F.substring(F.md5(c), 1, 16), F.lit("none"))


def grams(block: Block, order: int = ORDER) -> np.ndarray:
    """For each byte, it and the ``order`` - 1 bytes before it in its row (zero before the start) as one integer."""
    data = block.data.astype(np.uint64)
    out = data.copy()
    first = block.bounds[:-1][np.diff(block.bounds) > 0]
    last = block.bounds[1:][np.diff(block.bounds) > 0]
    for j in range(1, order):
        back = np.zeros_like(data)
        back[j:] = data[: max(0, len(data) - j)]
        for t in range(j):
            at = first + t
            back[at[at < last]] = 0
        out |= back << np.uint64(8 * j)
    return out


def _tail(key: Column, order: int) -> Column:
    return key.bitwiseAND(F.lit((1 << 8 * order) - 1).cast("long"))


def _trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1 and doc_id is not null").select("doc_id")


def _trusted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(bloom_filter(ids))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(may_hold(shared.value, b.column(0)))

    rows = docs.select("doc_id", _language().alias("lang"), "text").where("doc_id is not null")
    return rows.mapInArrow(sift, "doc_id long, lang string, text string").join(ids, "doc_id", "left_semi")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n, text): counts of the training rows, and the held-out texts as they are."""
    names = ["lang", "gram", "n", "text"]
    counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (u, n) in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(n), pa.nulls(len(u), pa.string())], names=names)
        counts.clear()

    for batch in batches:
        held = mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) + np.uint64(5)) % np.uint64(HELD_OUT_IN) == 0
        out = batch.filter(pa.array(held))
        none = pa.nulls(out.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([out.column(1), none, none, out.column(2)], names=names)
        rest = batch.filter(pa.array(~held))
        for lang in rest.column(1).unique().to_pylist():
            own = rest.filter(pc.equal(rest.column(1), lang))
            for b in blocks(own.column(2), 1 << 18):
                u, n = np.unique(grams(b), return_counts=True)
                if lang in counts:
                    have, had = counts[lang]
                    u, inverse = np.unique(np.concatenate([have, u]), return_inverse=True)
                    n = np.bincount(inverse, np.concatenate([had, n])).astype(np.int64)
                counts[lang] = (u, n.astype(np.int64))
        if sum(len(u) for u, _ in counts.values()) > 1_000_000:
            yield from flush()
    yield from flush()


def _smoothed(counts: DataFrame, lower: DataFrame | None, order: int) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, p) and (lang, ctx, gamma) of one order from its (lang, gram, n)."""
    number = lambda k: F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"n{k}")
    of = counts.groupBy("lang").agg(*map(number, (1, 2, 3, 4)))
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    raw = [F.lit(k) - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")) for k in (1, 2, 3)]
    # Where counts of counts are too few to tell, and never none or all of a count.
    kept = [F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), F.coalesce(d, F.lit(0.5)))).alias(f"d{k}") for k, d in zip((1, 2, 3), raw)]
    of = scratch.save(of.select("lang", *kept), "discounts")  # a row a language, so a table that Spark can see the size of
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = counts.join(of, "lang").select("lang", "gram", "n", d.alias("d"), F.shiftright("gram", 8).alias("ctx"))
    contexts = scratch.save(rows.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("gamma")), "contexts")
    rows = rows.join(contexts, ["lang", "ctx"])
    if lower is None:
        below = F.lit(1 / 256)
    else:
        rows = rows.withColumn("low", _tail(F.col("gram"), order - 1)).join(lower.select("lang", F.col("gram").alias("low"), F.col("p").alias("q")), ["lang", "low"])
        below = F.col("q")
    p = (F.col("n") - F.col("d")) / F.col("total") + F.col("gamma") * below
    return scratch.save(rows.select("lang", "gram", p.alias("p")), "model"), contexts


def train(docs: DataFrame, labels: DataFrame) -> tuple[str, int, DataFrame]:
    """Model folder, number of shards, and (lang, text) of the held-out trusted documents."""
    spark = docs.sparkSession
    ids = scratch.save(_trusted_ids(labels), "trusted")
    read = scratch.save(_trusted(docs, ids).mapInArrow(frees(_counted), "lang string, gram long, n long, text string"), "counted")
    scratch.drop(ids)
    counts = {ORDER: scratch.save(read.where("gram is not null").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")}
    for order in range(ORDER - 1, 0, -1):
        shorter = counts[order + 1].select("lang", _tail(F.col("gram"), order).alias("gram"))
        counts[order] = scratch.save(shorter.groupBy("lang", "gram").agg(F.count("*").alias("n")), "grams")
    lower, rows, stored = None, [], list(counts.values())
    for order in range(1, ORDER + 1):
        lower, contexts = _smoothed(counts[order], lower, order)
        stored += [lower, contexts]
        kind = lambda k: F.lit(k).alias("kind")
        rows += [lower.select("lang", kind(order), F.col("gram").alias("key"), F.col("p").alias("value"))]
        rows += [contexts.select("lang", kind(_CONTEXT + order), F.col("ctx").alias("key"), F.col("gamma").alias("value"))]
    model = rows[0]
    for r in rows[1:]:
        model = model.unionByName(r)
    shards = counts[ORDER].count() // SHARD_ROWS + 1
    where = ["lang", "kind", "shard"]
    model = model.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    path = scratch.new_path(spark, "kneser-ney")
    model.repartition(*where).sortWithinPartitions(*where, "key").write.partitionBy(*where).parquet(path)
    scratch.drop(*stored)
    return path, shards, read.where("text is not null").select("lang", "text")


class Model:
    """A worker's view of the shards: the most recent of them, and a memo of probabilities."""

    MOST_ROWS, SLOT_BITS = 6_000_000, 19

    def __init__(self, path: str, shards: int) -> None:
        self.path, self.shards = path, shards
        self.files, self.root = pyarrow.fs.FileSystem.from_uri(path)
        self.held: OrderedDict[tuple[str, int, int], tuple[np.ndarray, np.ndarray]] = OrderedDict()
        self.memo: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def shard(self, lang: str, kind: int, number: int) -> tuple[np.ndarray, np.ndarray]:
        name = (lang, kind, number)
        if name not in self.held:
            folder = f"{self.root}/lang={lang}/kind={kind}/shard={number}"
            listed = self.files.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
            tables = [pq.ParquetFile(self.files.open_input_file(f.path)).read() for f in listed if f.path.endswith(".parquet")]
            keys = np.concatenate([np.zeros(0, np.int64), *(t.column("key").to_numpy() for t in tables)]).view(np.uint64)
            values = np.concatenate([np.zeros(0), *(t.column("value").to_numpy() for t in tables)])
            order = np.argsort(keys)
            self.held[name] = keys[order], values[order]
            while sum(len(k) for k, _ in self.held.values()) > self.MOST_ROWS and len(self.held) > 1:
                self.held.popitem(last=False)
        self.held.move_to_end(name)
        return self.held[name]

    def lookup(self, lang: str, kind: int, wanted: np.ndarray) -> np.ndarray:
        """The stored values, NaN where there is none."""
        out = np.full(len(wanted), np.nan)
        of = wanted % np.uint64(self.shards)
        for number in np.unique(of):
            keys, values = self.shard(lang, kind, int(number))
            mine = np.flatnonzero(of == number)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, wanted[mine]), len(keys) - 1)
                hit = keys[at] == wanted[mine]
                out[mine[hit]] = values[at[hit]]
        return out

    def log_p(self, lang: str, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), 1 / 256)
        for order in range(1, ORDER + 1):
            key = keys & np.uint64((1 << 8 * order) - 1)
            seen = self.lookup(lang, order, key)
            gamma = self.lookup(lang, _CONTEXT + order, key >> np.uint64(8))
            p = np.where(np.isnan(seen), np.where(np.isnan(gamma), p, gamma * p), seen)
        return np.log(p)

    def knows(self, lang: str) -> bool:
        return len(self.shard(lang, _CONTEXT + 1, 0)[0]) > 0

    def scores(self, lang: str, blocks_: list[np.ndarray]) -> Iterator[np.ndarray]:
        """log p of the n-grams of each block, by way of a direct-mapped memo; those not in it are looked up for all blocks at once."""
        if lang not in self.memo:
            if len(self.memo) >= 8:
                self.memo.clear()
            self.memo[lang] = np.full(1 << self.SLOT_BITS, np.iinfo(np.uint64).max, np.uint64), np.zeros(1 << self.SLOT_BITS)
        known, values = self.memo[lang]
        slot_of = lambda keys: ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        slots = [slot_of(keys) for keys in blocks_]
        misses = [np.flatnonzero(known[slot] != keys) for slot, keys in zip(slots, blocks_)]
        new = np.concatenate([np.zeros(0, np.uint64), *(keys[miss] for keys, miss in zip(blocks_, misses))])
        distinct, inverse = np.unique(new, return_inverse=True)
        found = self.log_p(lang, distinct)
        done = 0
        for slot, miss in zip(slots, misses):
            out = values[slot]
            out[miss] = found[inverse[done : done + len(miss)]]
            done += len(miss)
            yield out
        at = slot_of(distinct)
        known[at], values[at] = distinct, found


_MODELS: dict[str, Model] = {}


def _model(path: str, shards: int) -> Model:
    if path not in _MODELS:
        _MODELS.clear()
        _MODELS[path] = Model(path, shards)
    return _MODELS[path]


def score(docs: DataFrame, path: str, shards: int, lang_key: Column) -> DataFrame:
    """``docs`` with ``perplexity`` (null without text or without a model of the language)."""
    keep = [c for c in docs.columns if c not in ("perplexity", "_model_lang")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "_model_lang string", "perplexity double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path, shards)
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            langs = np.array(table.column("_model_lang").to_pylist(), object)
            result = np.full(batch.num_rows, np.nan)
            total, sizes = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            known = {lang: model.knows(lang) for lang in set(langs)}
            cut = list(blocks(table.column("text"), 1 << 18))
            for lo in range(0, len(cut), 4):
                parts = [(grams(b), np.repeat(np.arange(b.first, b.first + b.n_rows), np.diff(b.bounds))) for b in cut[lo : lo + 4]]
                for b in cut[lo : lo + 4]:
                    sizes[b.first : b.first + b.n_rows] = np.diff(b.bounds)
                for lang in known:
                    rows = langs == lang
                    own = [(keys[at], of[at]) for keys, of in parts if known[lang] and (at := rows[of]).any()]
                    for (_, of), logs in zip(own, model.scores(lang, [keys for keys, _ in own]) if own else ()):
                        total += np.bincount(of, logs, minlength=batch.num_rows)
            judged = (sizes > 0) & np.array([known[lang] for lang in langs])
            result[judged] = np.exp(-total[judged] / sizes[judged])
            yield from table.append_column("perplexity", pa.array(result, mask=np.isnan(result))).combine_chunks().to_batches()

    return docs.select(*keep, lang_key.alias("_model_lang")).mapInArrow(frees(run, "kneser_ney", lambda: _MODELS.clear()), schema)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.995) -> DataFrame:
    """``docs`` with ``perplexity``, ``threshold`` (its language's) and ``kept``."""
    small_batches(docs.sparkSession)
    path, shards, held = train(docs, labels)
    measured = score(held, path, shards, F.col("lang")).where("perplexity is not null")
    limits = measured.groupBy(F.col("_model_lang").alias("_limit_lang")).agg(F.percentile_approx("perplexity", quantile, 10_000).alias("threshold"))
    limits = scratch.save(limits, "limits")
    clean = docs.drop("perplexity", "threshold", "kept", "_model_lang")
    scored = score(clean, path, shards, _language())
    judged = scored.join(limits, scored["_model_lang"] == limits["_limit_lang"], "left").drop("_limit_lang", "_model_lang")
    has_text = F.length(F.coalesce("text", F.lit(""))) > 0
    return judged.withColumn("kept", has_text & (F.col("threshold").isNull() | F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))))
