"""Mixing sources to target weights by hash thresholds, in SQL operators alone.

A document's hash is 60 bits of the MD5 of its doc_id and text, so it is the
same in each run.  Per source, a target of whole passes plus a rest is met by
taking every document that many times and, once more, those whose hash lies
under the source's threshold; thresholds of growing targets nest.  The
threshold comes from histograms of words by source and leading hash bits: the
bucket in which the budget runs out is found by a running sum over a bounded
number of buckets, and only that bucket's documents are looked at again by
their next bits.  Three levels of 12 bits leave a bucket of 2^-36 of a source;
it is taken if that comes nearer to the target.  No document is sorted.

Defined results: null and empty texts have size 0; a null source is a source
of its own, the last; repeated rows are taken alike; rows without a doc_id take
part; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm import scratch

_HASH_BITS, _LEVEL_BITS, _LEVELS = 60, 12, 3


def _size_and_hash() -> tuple[Column, Column]:
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))
    h = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    return size.alias("size"), h.alias("h")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h) of each document; the text is read here only."""
    return docs.select("doc_id", "source", *_size_and_hash())


def targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources in code-point order, null last, have the weights in turn and share
    ``percent`` % of all sizes; none gets over ``most`` times its size, and
    what that leaves is shared by weight among the others.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long")
    rows = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    # In order of cap / w, a source stops at its cap if what is left for it and all after it would give it more.
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("budget", F.sum("source_size").over(everything) * F.lit(percent) / 100)
    rows = rows.withColumn("caps", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("ws", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("full", F.col("cap") * F.col("ws") <= (F.col("budget") - F.col("caps")) * F.col("w"))
    capped = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)
    open_w = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(everything)
    share = (F.col("budget") - capped) * F.col("w") / open_w
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), share)).alias("target"))


def _same_source(left: DataFrame, right: DataFrame) -> DataFrame:
    renamed = right.withColumnRenamed("source", "s")
    return left.join(renamed, left["source"].eqNullSafe(renamed["s"])).drop("s")


def thresholds(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds to ``wanted`` the columns passes and threshold: documents are taken ``passes`` times, and once more below ``threshold``."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = wanted.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    state = scratch.save(state.withColumn("path", F.lit(0).cast("long")), "mix")
    for level in range(1, _LEVELS + 1):
        shift = _HASH_BITS - level * _LEVEL_BITS
        inside = documents
        if level > 1:
            found = _same_source(documents.select("source", "size", "h"), state.select("source", "path"))
            inside = found.where(F.shiftright("h", shift + _LEVEL_BITS) == F.col("path"))
        buckets = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        buckets = _same_source(buckets, state.select("source", "rest"))
        order = Window.partitionBy("source").orderBy("bucket")
        running = buckets.withColumn("upto", F.sum("size").over(order))
        at = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", F.col("upto"), F.col("size").alias("own")))).alias("at")
        edge = running.groupBy("source").agg(at).withColumnRenamed("source", "s")
        joined = state.join(edge, state["source"].eqNullSafe(edge["s"]), "left").drop("s")
        past = F.shiftleft(F.col("path") + 1, _LEVEL_BITS)  # a budget that no bucket exceeds takes them all
        bucket = F.coalesce(F.col("at.bucket"), past if level > 1 else F.lit(1 << _LEVEL_BITS).cast("long"))
        left = F.col("rest") - F.coalesce(F.col("at.upto") - F.col("at.own"), F.lit(0))
        if level == _LEVELS:
            nearer = F.coalesce((F.col("at.upto") - F.col("rest")) < left, F.lit(False))
            bucket = bucket + F.when(nearer, 1).otherwise(0)
        new = joined.select("source", "source_size", "target", "passes", left.alias("rest"), bucket.alias("path"))
        new = scratch.save(new, "mix")
        scratch.drop(state)
        state = new
    return state.select("source", "source_size", "target", "passes", F.shiftleft("path", _HASH_BITS - _LEVELS * _LEVEL_BITS).alias("threshold"))


def _limits(documents: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    sizes = documents.groupBy("source").agg(F.sum("size").alias("source_size"))
    return thresholds(documents, targets(sizes, weights, percent, most))


def _times() -> Column:
    return F.col("passes") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken (words, repeats counted)."""
    documents = scratch.save(sized(docs), "sized")
    limits = _limits(documents, weights, percent, most)
    return _same_source(documents, limits).select("doc_id", "size", "source_size", "target", (F.col("size") * _times()).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken.  No text is shuffled."""
    stored = scratch.save(sized(docs), "sized")
    limits = _limits(stored, weights, percent, most).select("source", "passes", "threshold")
    _, h = _size_and_hash()
    rows = _same_source(docs.select(F.struct(*docs.columns).alias("row"), "source", h), limits).withColumn("times", _times().cast("int"))
    taken = rows.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    return taken.select("row.*")
