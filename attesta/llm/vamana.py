"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard.

Rows with equal vectors stand for one point that keeps its smallest
identifiers, as many as a query can return; ties go to smaller identifiers, so
more can't matter.  Points are dealt to shards of about ``shard_points`` by
hash.  In a shard, a point's neighbours are proposed by a greedy search from
the medoid over the graph so far, and pruned: a candidate is dropped if a
nearer neighbour that was kept is, times ``alpha``, nearer to it than the
point.  Kept edges are also added the other way round, pruned again where a
point has too many.  Points are added in batches, first with alpha 1, then all
again with the given one.  Every block of queries meets every shard in a task of
its own, where a beam search over the stored graph finds candidates; their
distances are computed anew in double precision and each query keeps the best of
all shards.  Graphs are built and walked on vectors scaled by a power of two, so
that any finite sizes do.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, as query or candidate; only vectors of one length are
compared; of repeated rows with one vec_id and vector one counts, and of rows
that share a vec_id a query is the one of least vector; a query never finds
its own vec_id; null vec_ids take no part; further columns are ignored; fewer
candidates than asked for give fewer rows, an empty table none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm import scratch
from attesta.llm.arrowtools import runs, small_batches

DEGREE, BEAM, ALPHA, BATCH, BEAM_SEARCH = 32, 64, 1.2, 256, 128


def distances(data: np.ndarray, a: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances from each row of ``a`` to the rows ``ids`` of ``data``; infinite where an id is negative."""
    d = data[ids] - a[:, None, :]
    out = np.einsum("qkd,qkd->qk", d, d)
    out[ids < 0] = np.inf
    return out


def beam_search(data: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int, visited: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The nearest ``beam`` points found for each query, nearest first, and their squared distances (-1 and infinite where there are fewer).

    With ``visited``, every point that was expanded is returned instead.
    """
    q = len(queries)
    ids = np.full((q, beam), -1)
    ids[:, 0] = start
    far = np.full((q, beam), np.inf, data.dtype)
    far[:, 0] = distances(data, queries, ids[:, :1])[:, 0]
    done = np.zeros((q, beam), bool)
    seen = np.zeros((q, len(data)), bool)
    seen[:, start] = True
    expanded = []
    active = np.arange(q)
    while len(active):
        open_ = ~done[active] & (ids[active] >= 0)
        has = open_.any(1)
        active = active[has]
        if not len(active):
            break
        at = open_[has].argmax(1)
        node = ids[active, at]
        done[active, at] = True
        if visited:
            step = np.full(q, -1)
            step[active] = node
            expanded.append(step)
        near = graph[node]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        near = np.where(fresh, near, -1)
        rows, cols = np.nonzero(fresh)
        seen[active[rows], near[rows, cols]] = True
        all_ids = np.concatenate([ids[active], near], 1)
        all_far = np.concatenate([far[active], distances(data, queries[active], near)], 1)
        all_done = np.concatenate([done[active], np.zeros(near.shape, bool)], 1)
        order = np.argsort(all_far, 1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(all_ids, order, 1)
        far[active] = np.take_along_axis(all_far, order, 1)
        done[active] = np.take_along_axis(all_done, order, 1)
    if visited:
        walked = np.stack(expanded, 1) if expanded else np.full((q, 1), -1)
        return np.concatenate([walked, ids], 1), far
    return ids, far


def robust_prune(data: np.ndarray, points: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each point out of a row of candidates (negative: none)."""
    candidates = np.where(candidates == points[:, None], -1, candidates)
    candidates = np.sort(candidates, 1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    far = distances(data, data[points], candidates)
    order = np.argsort(far, 1, kind="stable")[:, : 3 * degree]
    candidates, far = np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1)
    alive = np.isfinite(far)
    vectors = data[candidates]
    out = np.full((len(points), degree), -1)
    rows = np.arange(len(points))
    for k in range(degree):
        any_ = alive.any(1)
        if not any_.any():
            break
        at = alive.argmax(1)
        out[any_, k] = candidates[rows, at][any_]
        d = vectors - vectors[rows, at][:, None, :]
        between = np.einsum("qkd,qkd->qk", d, d)
        alive &= alpha * alpha * between > far
        alive[rows, at] = False
        alive[~any_] = False
    return out


def build(data: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = BATCH) -> tuple[np.ndarray, int]:
    """(neighbours of each point, the entry point)."""
    n = len(data)
    start = int(((data - data.mean(0)) ** 2).sum(1).argmin())
    graph = np.full((n, degree), -1)
    order = np.random.Generator(np.random.PCG64(7)).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    for a in (1.0, alpha):
        at = 1 if a == 1.0 else 0
        while at < n:
            size = min(batch, at) if a == 1.0 else batch
            points = order[at : at + size]
            at += size
            found, _ = beam_search(data, graph, start, data[points], beam, visited=True)
            found = np.concatenate([found, graph[points]], 1)
            chosen = robust_prune(data, points, found, a, degree)
            graph[points] = chosen
            source, target = np.repeat(points, degree), chosen.ravel()
            source, target = source[target >= 0], target[target >= 0]
            if not len(target):
                continue
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            nodes, first, count = np.unique(target, return_index=True, return_counts=True)
            slots = np.full((len(nodes), count.max()), -1)
            slots[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
            joined = np.concatenate([graph[nodes], slots], 1)
            room = (graph[nodes] >= 0).sum(1) + count <= degree
            packed = np.sort(np.where(joined < 0, n, joined), 1)
            packed[:, 1:][packed[:, 1:] == packed[:, :-1]] = n
            packed = np.sort(packed, 1)
            if packed.shape[1] < degree:
                packed = np.pad(packed, ((0, 0), (0, degree - packed.shape[1])), constant_values=n)
            graph[nodes[room]] = np.where(packed[room, :degree] == n, -1, packed[room, :degree])
            if (~room).any():
                graph[nodes[~room]] = robust_prune(data, nodes[~room], joined[~room], a, degree)
    return graph, start


def _vectors(column: pa.Array | pa.ChunkedArray, width: int, dtype: str) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, width)


_INDEX = "shard int, width int, ids array<long>, vec array<double>, near array<int>, start int"


def scaled(vectors: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Vectors over a power of two, so that squares neither overflow nor vanish; in single precision where their sizes allow it, else in double."""
    sizes = np.concatenate([np.abs(v).max(1) for v in (vectors, *more)])
    most = float(sizes.max(initial=0.0))
    factor = 2.0 ** -np.frexp(most)[1] if most else 1.0
    wide = sizes.min(initial=most) < most * 1e-12
    # In two steps, as one factor may be beyond the range of a double.
    half = 2.0 ** (np.log2(factor) // 2)
    return [(v * half * (factor / half)).astype("float64" if wide else "float32") for v in (vectors, *more)]


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in runs(batches, ["width", "shard"]):
        (data,) = scaled(_vectors(t.column("vec"), t.column("width")[0].as_py(), "float64"))
        graph, start = build(data)
        n = len(data)
        flat = graph.ravel().astype(np.int32)
        near = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * graph.shape[1]), pa.array(flat))
        t = t.select(["shard", "width", "ids", "vec"]).append_column("near", near).append_column("start", pa.array(np.full(n, start), pa.int32()))
        yield from t.combine_chunks().to_batches(max_chunksize=1000)


def usable_rows(rows: DataFrame, identifier: str, vector: str) -> DataFrame:
    """Distinct (id, vec) of the rows that take part."""
    v = F.col(vector)
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    doubles = F.transform(v, lambda x: x.cast("double") + 0.0)  # also makes -0.0 into 0.0
    return rows.where(F.col(identifier).isNotNull() & usable).select(F.col(identifier).cast("long").alias("id"), doubles.alias("vec")).distinct()


def points_of(rows: DataFrame, keep: int) -> DataFrame:
    """(width, vec, ids): distinct vectors of (id, vec) with their ``keep`` smallest identifiers."""
    # Spark keeps only the first ranks of each map task before the shuffle.
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("rank") <= keep)
    return ranked.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.size("vec").alias("width"), "vec", "ids")


def index(points: DataFrame, shard_points: int = 8192) -> str:
    """Build the shards' graphs; returns the folder that has a folder of rows for each, neighbours being places among its rows."""
    spark = points.sparkSession
    points = scratch.save(points, "points")
    sizes = points.groupBy("width").agg(F.ceil(F.count("*") / shard_points).cast("int").alias("shards"))
    dealt = points.join(sizes, "width").withColumn("shard", F.pmod(F.xxhash64("vec"), F.col("shards")).cast("int"))
    # A number of partitions that is given is kept, so that no task builds several shards while others wait.
    parts = 2 * (points.count() // shard_points + 1)
    ordered = dealt.select("shard", "width", "ids", "vec").repartitionByRange(parts, "width", "shard").sortWithinPartitions("width", "shard", "ids")
    path = scratch.new_path(spark, "vamana")
    ordered.mapInArrow(_build, _INDEX).write.partitionBy("width", "shard").option("compression", "zstd").parquet(path)
    scratch.drop(points)
    return path


def _read_folder(path: str, columns: list[str]) -> pa.Table:
    """The rows of a folder's Parquet files, in the order of the files' names."""
    files, at = pyarrow.fs.FileSystem.from_uri(path)
    listed = sorted(f.path for f in files.get_file_info(pyarrow.fs.FileSelector(at)) if f.path.endswith(".parquet"))
    return pa.concat_tables([pq.ParquetFile(files.open_input_file(f)).read(columns=columns) for f in listed]).combine_chunks()


def exact_distances(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; differences whose squares overflow or vanish are scaled first."""
    d = points - query
    far = np.sqrt(np.einsum("kd,kd->k", d, d))
    most = np.abs(d).max(1, initial=0.0)
    odd = np.flatnonzero(~np.isfinite(far) | ((far < 1e-140) & (most > 0)))
    if len(odd):
        unit = d[odd] / most[odd, None]
        far[odd] = most[odd] * np.sqrt(np.einsum("kd,kd->k", unit, unit))
    return far


def _search(index_: str, queries: str, k: int, beam: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, shard, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
                points = _read_folder(f"{index_}/width={width}/shard={shard}", ["ids", "vec", "near", "start"])
                asked = _read_folder(f"{queries}/width={width}/block={block}", ["id", "vec"])
                exact, wanted = _vectors(points.column("vec"), width, "float64"), _vectors(asked.column("vec"), width, "float64")
                graph = _vectors(points.column("near"), len(points.column("near")[0]), "int64")
                start, ids, qid = points.column("start")[0].as_py(), points.column("ids").to_pylist(), asked.column("id").to_pylist()
                for lo in range(0, len(qid), 256):
                    some = wanted[lo : lo + 256]
                    data, targets = scaled(exact, some)
                    found, _ = beam_search(data, graph, start, targets, beam)
                    out = [[], [], []]
                    for i, own in enumerate(qid[lo : lo + 256]):
                        at = found[i][found[i] >= 0]
                        far = exact_distances(exact[at], some[i])
                        best = sorted((f, v) for p, f in zip(at.tolist(), far.tolist()) for v in ids[p] if v != own)[:k]
                        out[0] += [own] * len(best)
                        out[1] += [v for _, v in best]
                        out[2] += [f for f, _ in best]
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def search(spark: SparkSession, index_: str, queries: DataFrame, k: int = 10, beam: int = BEAM_SEARCH, block_queries: int = 4096) -> DataFrame:
    """The ``k`` nearest found of each query (id, width, vec): query_id, rank, vec_id, score.

    A task searches one shard for one block of queries and reads just these two;
    no vector is shuffled but for the queries, once.
    """
    stored = scratch.save(queries, "queries")
    blocks = max(1, -(-stored.count() // block_queries))
    path = scratch.new_path(spark, "blocks")
    dealt = stored.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    dealt.repartition(blocks, "width", "block").sortWithinPartitions("width", "block", "id").write.partitionBy("width", "block").parquet(path)
    found_queries, found_shards = (spark.read.option("recursiveFileLookup", "false").schema(f"{c}, width int, {n} int").parquet(p) for p, c, n in ((path, "id long", "block"), (index_, "start int", "shard")))
    shards, asked = found_shards.select("width", "shard").distinct(), found_queries.select("width", "block").distinct()
    tasks = scratch.save(shards.join(asked, "width").select("width", "shard", "block"), "tasks")
    spread = tasks.repartition(max(1, min(tasks.count(), 100_000)))
    found = spread.mapInArrow(_search(index_, path, k, beam), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, identifier: str, vector: str, is_query: Column, k: int = 10, shard_points: int = 8192, beam: int | None = None) -> DataFrame:
    """Index all ``rows`` and search them for those that ``is_query`` selects."""
    spark = rows.sparkSession
    small_batches(spark)
    asked = usable_rows(rows.where(is_query), identifier, vector).groupBy("id").agg(F.min("vec").alias("vec"))
    points = points_of(usable_rows(rows, identifier, vector), k + 1)
    if points.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(spark, index(points, shard_points), asked.withColumn("width", F.size("vec")), k, beam or BEAM_SEARCH)
