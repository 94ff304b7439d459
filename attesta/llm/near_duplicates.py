"""MinHash near-duplicate removal by a multi-index Hamming join.

A document's set holds the 64-bit hashes of its distinct runs of ``width``
words (ASCII letters lower-cased); a shorter text is one run of all its words,
a text without words has the empty set and is linked with nothing.

* Documents with equal sets form a *class*, found by a 128-bit digest.
* A class's signature is 64 b-bit minima (b = 16).  Two sets of similarity s
  differ in each position with probability at most 1 - s, so a distance limit
  is set from the binomial tail (``plan_for``); links beyond it are lost with a
  probability of about 1e-6 a pair.
* Pigeonhole: with C chunks and a limit below 2C, two signatures within the
  limit agree on some chunk up to one position.  Every chunk is therefore
  stored once for each position left out, and equal keys meet.
* Classes that share a key form a group named after its smallest member, the
  centre.  Groups of one family are merged.  Members within the distance limit
  of their centre are compared with it on full sets, one at a time.  Those that
  it doesn't link, and those that are farther, are *open*: each is compared with
  the whole group, by signature and then on full sets, in tasks that hold a
  block of open members and one of all, of bounded numbers and bytes.  What is
  in one component already is not compared again, and no list of all pairs is
  ever made.
* Each class goes to the least class that it is linked to, and links between
  such stars are joined to components by ``components``.
* Rows of one group, key, class or component are dealt by salt where they are
  many, so none meets in one task.

Defined results: null and empty texts have n_shingles 0 and stand alone;
repeated rows are linked; rows without a doc_id take part but can't name a
component (component_id is the smallest doc_id present, or null if none is, and
such a row counts as kept only then).  Further input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm import scratch
from attesta.llm.arrowtools import fixed_binary, frees, matrix, runs, small_batches
from attesta.llm.bloom import bloom_filter, may_hold
from attesta.llm.components import components
from attesta.llm.salting import hot_keys, repeated, salted_join, spread
from attesta.llm.wordhash import Block, blocks, distinct_per_row, mix, span_hashes, windows, words

POSITIONS = 64
_FACTORS = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def plan_for(percent: int, miss: float = 2e-6) -> tuple[int, int]:
    """(distance limit, number of chunks) for similarities of ``percent`` / 100 and more."""
    p = 1 - percent / 100
    tail, limit = 1.0, -1
    while tail > miss:
        limit += 1
        tail -= math.comb(POSITIONS, limit) * p**limit * (1 - p) ** (POSITIONS - limit)
    chunks = min(POSITIONS // 2, limit // 2 + 1)
    return min(limit, 2 * chunks - 1), chunks


def sets_of(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted shingle hashes of each row, end to end, and their bounds."""
    w = words(block)
    h = span_hashes(block, w.start, w.end, lower=True)
    return distinct_per_row(*windows(h, w.bounds, width, short=True))


def digests(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 128-bit digest of each set (two sums of scrambled hashes); zero for the empty set."""
    out = np.zeros((len(bounds) - 1, 2), np.uint64)
    for k, salt in enumerate((0x1B873593, 0x2545F491)):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values + np.uint64(salt)), out=total[1:])
        out[:, k] = total[bounds[1:]] - total[bounds[:-1]]
    return out


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bounds) - 1, POSITIONS), np.uint16)
    for i in np.flatnonzero(np.diff(bounds)):
        least = None
        for at in range(bounds[i], bounds[i + 1], 4096):
            part = (values[at : min(at + 4096, bounds[i + 1]), None] * _FACTORS).min(0)
            least = part if least is None else np.minimum(least, part)
        out[i] = (mix(least) >> np.uint64(40)).astype(np.uint16)
    return out


def _describe(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                values, bounds = sets_of(b, width)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(b.first, b.n_rows),
                        pa.array(np.diff(bounds), pa.int64()),
                        fixed_binary(digests(values, bounds)),
                        fixed_binary(signatures(values, bounds)),
                    ],
                    names=["doc_id", "n_shingles", "cls", "sig"],
                )

    return run


def _chunks(n: int) -> list[tuple[int, int]]:
    edges = [POSITIONS * k // n for k in range(n + 1)]
    return list(zip(edges, edges[1:]))


def _keys(n_chunks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each chunk and each position left out of it, a key of the positions that remain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = matrix(batch.column(1), np.uint16, POSITIONS).astype(np.uint64)
            for lo, hi in _chunks(n_chunks):
                for out in range(lo, hi):
                    key = np.full(len(sig), out + 1, np.uint64)
                    for q in range(lo, hi):
                        if q != out:
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, q])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], names=["key", "cls"])

    return run


def _near(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to (g, cls, sig, g_sig) whether the two signatures are within ``limit``, in place of the second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = (matrix(b.column(2), np.uint16, POSITIONS) != matrix(b.column(3), np.uint16, POSITIONS)).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(far <= limit)], names=["g", "cls", "sig", "near"])

    return run


def _to_centres(rows: DataFrame, signatures: DataFrame, hot: DataFrame, limit: int) -> DataFrame:
    """(g, cls, sig, near) of members (g, cls, sig): whether each is within ``limit`` of its group's centre, the class that names it."""
    own = repeated(signatures.select(F.col("cls").alias("g"), F.col("sig").alias("g_sig")), hot, "g")
    both = spread(rows, hot, "g", "cls").join(own, ["g", "_salt"])
    return both.select("g", "cls", "sig", "g_sig").mapInArrow(_near(limit), "g binary, cls binary, sig binary, near boolean")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have the similarity that is asked."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) and len(b) else 0
    return 100 * common >= percent * (len(a) + len(b) - common)


def _with_centre(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(g, cls, linked) of a stream of (g, part, is_member, cls, shingles) in this order: each member against the centre that comes before it; one set and a batch are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, np.zeros(0, np.uint64)
        for batch in batches:
            gs, parts, members, sets = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4)
            keep, linked = [], []
            for i, (g, part, member) in enumerate(zip(gs, parts, members)):
                own = np.frombuffer(sets[i].as_buffer(), np.uint64)
                if not member:
                    at, centre = (g, part), own.copy()
                elif at == (g, part):
                    keep.append(i)
                    linked.append(_similar(own, centre, percent))
            some = batch.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(3), pa.array(linked, pa.bool_())], names=["g", "cls", "linked"])

    return run


def _dealt(open_: DataFrame, members: DataFrame, weight: Column, block: int, block_bytes: int) -> DataFrame:
    """Tasks (g, i, j) that compare open members with all members of their group, in blocks of up to ``block`` members and about ``block_bytes`` bytes: both with is_open, i, j."""
    parts = lambda: F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(weight) / block_bytes), F.lit(1)).cast("int")
    of_open = open_.groupBy("g").agg(parts().alias("open_parts"))
    sizes = members.groupBy("g").agg(F.count("*").alias("n"), parts().alias("parts")).join(of_open, "g")
    sizes = scratch.save(sizes, "sizes")
    place = lambda n: F.pmod(F.xxhash64("cls"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = salted_join(open_, sizes, "g", "cls", how="inner").withColumn("is_open", F.lit(True)).withColumn("i", place("open_parts")).withColumn("j", upto("parts"))
    right = salted_join(members, sizes, "g", "cls", how="inner").withColumn("is_open", F.lit(False)).withColumn("j", place("parts")).withColumn("i", upto("open_parts"))
    return left.unionByName(right).drop("n", "parts", "open_parts")


def _in_tasks(df: DataFrame) -> DataFrame:
    return df.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "is_open", "cls")


def _close(t: pa.Table, limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each open row of a task, which of its other rows are within ``limit``: not itself, and not the centre if it was compared with that."""
    is_open = t.column("is_open").to_numpy()
    sig = matrix(t.column("sig"), np.uint16, POSITIONS)
    cls = t.column("cls").to_pylist()
    g, tested = t.column("g")[0].as_py(), t.column("near").to_numpy()
    rows, others = np.flatnonzero(is_open), np.flatnonzero(~is_open)
    names: dict[bytes, int] = {cls[o]: k for k, o in enumerate(others.tolist())}
    for lo in range(0, len(rows), 64):
        some = rows[lo : lo + 64]
        far = np.zeros((len(some), len(others)), np.uint8)
        for q in range(POSITIONS):
            far += sig[some, q, None] != sig[None, others, q]
        close = far <= limit
        for k, r in enumerate(some.tolist()):
            for out in (cls[r], g if tested[r] else None):
                if out in names:
                    close[k, names[out]] = False
            yield r, others[close[k]]


def _with_partner(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(g, cls, is_open) of open members that have another one within ``limit``, and of those others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["g", "i", "j"]):
            keep = np.zeros(t.num_rows, bool)
            for row, near in _close(t, limit):
                if len(near):
                    keep[row] = True
                    keep[near] = True
            if keep.any():
                yield from t.select(["g", "cls", "is_open"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def links_of_open(t: pa.Table, percent: int, limit: int) -> list[tuple[bytes, bytes]]:
    """Links from the open rows of a task to others, one for each of the others' components that an open row belongs to.

    Others with ``linked`` are one component, that of their centre; what is known of a component is not tested again.
    """
    cls, linked = t.column("cls").to_pylist(), t.column("linked").to_pylist()
    sets = t.column("shingles").to_pylist()
    parent = {c: c for c in cls}

    def root(c: bytes) -> bytes:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    g = t.column("g")[0].as_py()
    parent.setdefault(g, g)
    for c, known in zip(cls, linked):
        if known:
            parent[root(c)] = root(g)
    links = []
    for row, near in _close(t, limit):
        own = np.frombuffer(sets[row], np.uint64)
        for other in near.tolist():
            if root(cls[row]) != root(cls[other]) and _similar(own, np.frombuffer(sets[other], np.uint64), percent):
                links.append((cls[row], cls[other]))
                parent[root(cls[row])] = root(cls[other])
    return links


def _verify(percent: int, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["g", "i", "j"]):
            found = links_of_open(t, percent, limit)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], names=["a", "b"])

    return run


def _full_sets(docs: DataFrame, bloom: np.ndarray, width: int) -> DataFrame:
    """(cls, shingles) of the documents whose doc_id the filter may hold."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1).filter(may_hold(shared.value, batch.column(0)))):
                values, bounds = sets_of(b, width)
                sets = [values[lo:hi].tobytes() for lo, hi in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([fixed_binary(digests(values, bounds)), pa.array(sets, pa.binary())], names=["cls", "shingles"])

    return docs.mapInArrow(frees(run), "cls binary, shingles binary")


def _sets_for(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cls, shingles) of the classes ``wanted`` (cls, doc_id: one of its documents)."""
    stored = scratch.save(wanted, "wanted")
    found = _full_sets(docs, bloom_filter(stored), width).join(stored.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])
    sets = scratch.save(found, "sets")
    scratch.drop(stored)
    return sets


def _links(docs: DataFrame, classes: DataFrame, percent: int, width: int, block: int, block_bytes: int) -> DataFrame:
    """(a, b): links that connect just the classes that all links connect."""
    limit, n_chunks = plan_for(percent)
    signatures = classes.select("cls", "sig")
    keyed = signatures.mapInArrow(frees(_keys(n_chunks)), "key long, cls binary")
    shared = scratch.save(keyed.groupBy("key").agg(F.min("cls").alias("g"), F.count("*").alias("n")).where("n > 1"), "shared")
    pairs = scratch.save(salted_join(keyed, shared, "key", "cls", how="inner").select("g", "cls").distinct(), "pairs")
    scratch.drop(shared)
    hot = hot_keys(pairs.groupBy("g").agg(F.count("*").alias("n")), "g")
    starred = scratch.save(_to_centres(pairs.join(signatures, "cls").select("g", "cls", "sig"), signatures, hot, limit), "starred")
    scratch.drop(pairs)

    # A group whose centre is near the centre of another joins it, twice over.
    toward = starred.where("near and g <> cls").groupBy(F.col("cls").alias("g")).agg(F.min("g").alias("to"))
    toward = scratch.save(toward, "toward")
    twice = toward.join(toward.select(F.col("g").alias("to"), F.col("to").alias("_on")), "to", "left").select("g", F.coalesce("_on", "to").alias("to"))
    moved = spread(starred.select("g", "cls", "sig"), hot, "g", "cls").join(repeated(twice, hot, "g"), ["g", "_salt"], "left")
    merged = scratch.save(moved.select(F.coalesce("to", "g").alias("g"), "cls", "sig").dropDuplicates(["g", "cls"]), "merged")
    scratch.drop(starred, toward)
    hot = hot_keys(merged.groupBy("g").agg(F.count("*").alias("n")), "g")
    members = scratch.save(_to_centres(merged, signatures, hot, limit), "members")
    scratch.drop(merged)

    # Members near their centre are compared with it; the centre comes before them in each part of its group.
    near = members.where("near and g <> cls").select("g", "cls")
    ids = near.select("cls").union(near.select("g")).distinct()
    sets = _sets_for(docs, ids.join(classes.select("cls", "doc_id"), "cls"), width)
    centres = repeated(near.select("g").distinct(), hot, "g").select("g", "_salt", F.lit(False).alias("is_member"), F.col("g").alias("cls"))
    rows = spread(near, hot, "g", "cls").select("g", "_salt", F.lit(True).alias("is_member"), "cls").unionByName(centres).join(sets, "cls")
    rows = rows.select("g", "_salt", "is_member", "cls", "shingles").repartition("g", "_salt").sortWithinPartitions("g", "_salt", "is_member", "cls")
    compared = scratch.save(rows.mapInArrow(frees(_with_centre(percent)), "g binary, cls binary, linked boolean"), "compared")
    scratch.drop(sets)
    star = compared.where("linked").select(F.col("cls").alias("a"), F.col("g").alias("b"))

    # All others are compared with their whole group, first by signature.
    size = classes.select("cls", F.col("n_shingles").alias("size"))
    known = members.join(compared, ["g", "cls"], "left").select("g", "cls", "sig", (F.col("near") & (F.col("g") != F.col("cls"))).alias("near"), F.coalesce("linked", F.lit(False)).alias("linked"))
    known = scratch.save(known.join(size, "cls").withColumn("bytes", F.col("size") * 8 + 256), "known")
    scratch.drop(members)
    open_ = known.where("not linked and g <> cls")
    tried = _in_tasks(_dealt(open_, known, F.lit(POSITIONS * 2), block, block_bytes).select("g", "i", "j", "is_open", "cls", "sig", "near"))
    partners = scratch.save(tried.mapInArrow(frees(_with_partner(limit)), "g binary, cls binary, is_open boolean").distinct(), "partners")
    rest = star
    if not partners.isEmpty():
        sets = _sets_for(docs, partners.select("cls").distinct().join(classes.select("cls", "doc_id"), "cls"), width)
        told = scratch.save(known.join(partners, ["g", "cls"]), "told")
        tasks = _dealt(told.where("is_open").drop("is_open"), told.where("not is_open").drop("is_open"), F.col("bytes"), block, block_bytes).join(sets, "cls")
        tasks = _in_tasks(tasks.select("g", "i", "j", "is_open", "cls", "sig", "near", "linked", "shingles"))
        more = scratch.save(tasks.mapInArrow(frees(_verify(percent, limit)), "a binary, b binary"), "links")
        scratch.drop(sets, told)
        rest = star.unionByName(more)
    links = scratch.save(rest, "links")
    scratch.drop(compared, known, partners)
    return links


def _named(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(cls, component_id) of all classes: the smallest doc_id of what the links connect."""
    # Each class first goes to the least class that it is linked to; what remains are links between such stars.
    star = scratch.save(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("star")), "stars")
    per_end = links.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n"))
    ends = scratch.save(per_end.join(star, "node").select(F.col("node").alias("b"), F.col("star").alias("b_star"), "n"), "ends")
    far = salted_join(links, ends, "b", "a").join(star.withColumnRenamed("node", "a"), "a").select(F.col("star").alias("a"), F.coalesce("b_star", "b").alias("b")).where("a <> b").distinct()
    between = scratch.save(far, "between")
    joined = components(between)
    first = classes.select("cls", "doc_id").join(star.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "doc_id", F.coalesce("star", "cls").alias("node"))
    first = scratch.save(first, "first")
    sizes = first.groupBy("node").agg(F.count("*").alias("n"))
    of = scratch.save(joined.join(sizes, "node"), "components")
    names = scratch.save(salted_join(first, of, "node", "cls").select("cls", "doc_id", F.coalesce("component", "node").alias("component")), "names")
    least = scratch.save(names.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "least")
    named = scratch.save(salted_join(names, least, "component", "cls").select("cls", "component_id"), "named")
    scratch.drop(star, ends, between, first, of, names, least)
    return named


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, block: int = 1024, block_bytes: int = 32 << 20) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A ∩ B| >= percent * |A ∪ B|.  See the
    module's text for the method and for nulls, ties and repeated rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    described = scratch.save(docs.mapInArrow(frees(_describe(width)), "doc_id long, n_shingles long, cls binary, sig binary"), "described")
    some = described.where("n_shingles > 0")
    per = some.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n"))
    classes = scratch.save(per, "classes")
    links = _links(docs, classes, percent, width, block, block_bytes)
    named = _named(classes, links)
    named = scratch.save(named.join(classes.select("cls", "n"), "cls"), "named")
    scratch.drop(links, classes)
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    rows = described.select("doc_id", "n_shingles", "cls", F.coalesce("doc_id", F.monotonically_increasing_id()).alias("_row"))
    joined = salted_join(rows, named, "cls", "_row")
    result = joined.select("doc_id", "n_shingles", F.coalesce(alone, "component_id").alias("component_id"))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
