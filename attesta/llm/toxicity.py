"""Toxicity by a chain of sparse linear models.

Categories are predicted in order.  A category's logistic model sees which
words a document has (runs of letters, lower-cased), which beginnings of four to
six bytes they have, both hashed to 2^20 places, and the probabilities of the
categories before it.  In training those
probabilities are out-of-fold: for each fold of the sample they come from
models of the other folds, so a later model learns from what an earlier one
will be worth on new text.  An L1 penalty sets the weights of words that don't
matter to zero, so long texts gather no noise.

The models are fitted in one task on a bounded sample of the labelled rows:
``sample_rows`` of least hash of doc_id, of which those that come first as long
as they have no more than ``sample_places`` distinct places together (4 bytes
each, so the task's memory is bounded too).  Scoring reads every whole text.  A
category's threshold is the one of best F1 out of fold.

Defined results: a null or empty text has no words and the probabilities of the
intercepts; labels that are null don't take part, of several labels of a
document the largest counts, of several texts with one doc_id the one of least
hash is trained on; a category without both classes in the sample has
probability 0 and is never assigned; repeated rows are scored alike; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm import scratch
from attesta.llm.arrowtools import small_batches
from attesta.llm.bloom import bloom_filter, may_hold
from attesta.llm.wordhash import NO_LETTER, Block, blocks, distinct_per_row, hasher, mix, words

PLACES = 1 << 20
PREFIXES = (4, 5, 6)
FOLDS = 4


class Rows:
    """Binary rows in compressed form over the places that occur in at least ``least`` of them, each scaled by its rarity."""

    def __init__(self, flat: np.ndarray, bounds: np.ndarray, places: np.ndarray | None = None, scale: np.ndarray | None = None, least: int = 3) -> None:
        self.n = len(bounds) - 1
        if places is None:
            count = np.bincount(flat, minlength=PLACES)
            places = np.flatnonzero(count >= least)
            scale = np.sqrt(self.n / count[places])
        self.places, self.scale = places, scale
        at = np.full(PLACES, -1)
        at[places] = np.arange(len(places))
        column = at[flat]
        row = np.repeat(np.arange(self.n), np.diff(bounds))
        self.row, self.column = row[column >= 0], column[column >= 0]

    def only(self, columns: np.ndarray) -> Rows:
        """The same rows over some of the columns."""
        some = object.__new__(Rows)
        some.n, some.places, some.scale = self.n, self.places[columns], self.scale[columns]
        at = np.full(len(self.places), -1)
        at[columns] = np.arange(len(columns))
        new = at[self.column]
        some.row, some.column = self.row[new >= 0], new[new >= 0]
        return some

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, (w * self.scale)[self.column], minlength=self.n)

    def transposed_times(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, r[self.row], minlength=len(self.places)) * self.scale


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_one(rows: Rows, extra: np.ndarray, y: np.ndarray, used: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the places (L1) and of ``extra`` with an intercept (free), by accelerated proximal gradient on the ``used`` rows.

    A penalty of 1 is what the largest gradient of as many places that don't matter is expected to be.
    Places whose gradient is under nine tenths of the penalty where no word counts are left out from the start.
    """
    n = used.sum()
    share = y[used].mean()
    penalty = penalty * np.sqrt(2 * np.log(max(2, len(rows.places))) * share * (1 - share) / n)
    every = len(rows.places)
    screened = np.flatnonzero(np.abs(rows.transposed_times((share - y) * used)) / n >= 0.9 * penalty)
    rows = rows.only(screened)
    dense = np.column_stack([np.ones(rows.n), extra])
    w, b = _descend(rows, dense, y, used, penalty, steps)
    # The penalty also shrinks what it keeps: fit the places it chose again under a tenth of it.
    chosen = np.flatnonzero(w)
    w, b = _descend(rows.only(chosen), dense, y, used, penalty / 10, steps)
    weights = np.zeros(every)
    weights[screened[chosen]] = w * rows.scale[chosen]
    return weights, b


def _descend(rows: Rows, dense: np.ndarray, y: np.ndarray, used: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated proximal gradient descent with steps of the inverse of the largest curvature."""
    n = used.sum()
    v = np.random.Generator(np.random.PCG64(1)).standard_normal(len(rows.places))
    u = np.ones(dense.shape[1])
    norm = 1.0
    for _ in range(12):
        r = (rows.times(v) + dense @ u) * used
        v, u = rows.transposed_times(r) / n, dense.T @ r / n
        norm = np.sqrt(v @ v + u @ u)
        v, u = v / norm, u / norm
    step = 3.5 / norm
    w, b = np.zeros(len(rows.places)), np.zeros(dense.shape[1])
    w_ahead, b_ahead, t = w, b, 1.0
    for _ in range(steps):
        r = (_sigmoid(rows.times(w_ahead) + dense @ b_ahead) - y) * used
        w_new = w_ahead - step * rows.transposed_times(r) / n
        w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - step * penalty, 0)
        b_new = b_ahead - step * (dense.T @ r) / n
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w_ahead, b_ahead = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return w, b


def fit_chain(flat: np.ndarray, bounds: np.ndarray, labels: np.ndarray, fold: np.ndarray, penalty: float = 1.0, steps: int = 100) -> dict:
    """The chain's models: per category places, weights, dense weights (intercept, earlier probabilities) and threshold."""
    rows = Rows(flat, bounds)
    plain = rows.scale
    models, earlier = [], np.zeros((rows.n, 0))
    for c in range(labels.shape[1]):
        known = ~np.isnan(labels[:, c])
        y = np.nan_to_num(labels[:, c])
        both = 0 < y[known].sum() < known.sum()
        out = np.zeros(rows.n)
        if both:
            for f in range(FOLDS):
                w, b = fit_one(rows, earlier, y, known & (fold != f), penalty, steps)
                mine = fold == f
                out[mine] = _sigmoid(rows.times(w / plain) + np.column_stack([np.ones(rows.n), earlier]) @ b)[mine]
            w, b = fit_one(rows, earlier, y, known, penalty, steps)
            order = np.argsort(-out[known], kind="stable")
            hits = np.cumsum(y[known][order])
            f1 = 2 * hits / (np.arange(len(order)) + 1 + y[known].sum())
            # Between the last document taken and the first one left, so that neither sits on the edge.
            best = int(f1.argmax())
            p = out[known][order]
            threshold = float((p[best] + p[min(best + 1, len(p) - 1)]) / 2)
            kept = np.flatnonzero(w)
            models.append({"places": rows.places[kept], "weights": w[kept], "dense": b, "threshold": threshold, "f1": float(f1[best])})
        else:
            models.append(None)
        earlier = np.column_stack([earlier, out])
    return {"models": models}


def apply_chain(chain: dict, place: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Probabilities (rows x categories) of rows of word places, which may repeat."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    used = np.zeros(PLACES, bool)
    for m in chain["models"]:
        if m is not None:
            used[m["places"]] = True
    hit = used[place]
    pairs = np.unique(row[hit] * PLACES + place[hit])
    row, place = pairs // PLACES, pairs % PLACES
    out = np.zeros((n, len(chain["models"])))
    for c, m in enumerate(chain["models"]):
        if m is not None:
            w = np.zeros(PLACES)
            w[m["places"]] = m["weights"]
            z = np.bincount(row, w[place], minlength=n) + m["dense"][0] + out[:, :c] @ m["dense"][1:]
            out[:, c] = _sigmoid(z)
    return out


def _places(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """The places of each row's words and their beginnings, with repeats, and each row's bounds."""
    w = words(b, NO_LETTER)
    of = hasher(b, lower=True)
    kinds = [of(w.start, w.end), *(of(w.start, np.minimum(w.end, w.start + k)) + np.uint64(k) for k in PREFIXES)]
    return (np.column_stack(kinds) % np.uint64(PLACES)).astype(np.int64).ravel(), w.bounds * len(kinds)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], sample_rows: int = 6_000, sample_places: int = 30_000_000) -> dict:
    """Fit the chain on a sample of ``labels`` (doc_id and a 0/1 column a category)."""
    each = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max(F.col(c).cast("double")).alias(c) for c in categories))
    sample = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(bloom_filter(sample))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(may_hold(shared.value, batch.column(0)))
            for b in blocks(own.column(1)):
                place, bounds = _places(b)
                flat, bounds = distinct_per_row(place, bounds)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))
                text = hasher(b)(b.bounds[:-1], b.bounds[1:]).view(np.int64)
                yield pa.RecordBatch.from_arrays([own.column(0).slice(b.first, b.n_rows), pa.array(text), lists], names=["doc_id", "h", "places"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got).sort_by("doc_id").combine_chunks()
            places = t.column("places").combine_chunks()
            places = places.chunk(0) if isinstance(places, pa.ChunkedArray) else places
            y = np.column_stack([t.column(c).to_numpy().astype(float) for c in categories])
            fold = (mix(t.column("doc_id").to_numpy().view(np.uint64) + np.uint64(9)) % np.uint64(FOLDS)).astype(int)
            offsets = places.offsets.to_numpy()
            chain = fit_chain(places.flatten().to_numpy().astype(np.int64), (offsets - offsets[0]).astype(np.int64), y, fold)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(chain)], pa.binary())], names=["chain"])

    read = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(features, "doc_id long, h long, places array<int>")
    first = read.groupBy("doc_id").agg(F.min_by("places", "h").alias("places"))
    rows = scratch.save(first.join(sample, "doc_id").select("doc_id", "places", *categories), "sample")
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # of sample_rows rows at most
    upto = rows.select("doc_id", F.sum(F.size("places").cast("long")).over(order).alias("upto"))
    used = rows.join(upto.where(F.col("upto") <= sample_places), "doc_id", "left_semi")
    found = used.repartition(1).mapInArrow(fit, "chain binary").collect()
    scratch.drop(rows)
    return pickle.loads(found[0].chain) if found else {"models": [None] * len(categories)}


def score(docs: DataFrame, chain: dict, categories: list[str]) -> DataFrame:
    """doc_id, and for each category its probability ``p_<category>`` and ``is_<category>``."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    limits = [2.0 if m is None else m["threshold"] for m in chain["models"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                p = apply_chain(shared.value, *_places(b))
                columns = [pa.array(p[:, c]) for c in range(p.shape[1])]
                flags = [pa.array(p[:, c] > limits[c]) for c in range(p.shape[1])]
                names = ["doc_id", *(f"p_{c}" for c in categories), *(f"is_{c}" for c in categories)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.n_rows), *columns, *flags], names=names)

    schema = ", ".join(["doc_id long", *(f"p_{c} double" for c in categories), *(f"is_{c} boolean" for c in categories)])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, categories: list[str], sample_rows: int = 6_000) -> DataFrame:
    small_batches(docs.sparkSession)
    return score(docs, train(docs, labels, categories, sample_rows), categories)
