"""Nearest neighbours by largest inner product: probed lists with an adaptive dimension scan.

Vectors gain one component that makes all norms equal, so the largest inner product is the nearest
vector, and are rotated at random. Lists are k-means cells fitted on a bounded sample and grow with the
root of the rows; every vector is put in its cell, every query visits as many cells as the sample needed
for ``wanted`` recall, and more where those hold too few rows. Results come from the visited cells alone:
the sample gives the cells, the number of visits and, by its rows within them, a first limit.
Within a cell rotated vectors are read in column blocks, and after each block a hypothesis test on
the partial distance abandons those that are too far to matter. Survivors are ranked by the exact
inner product in double precision.

Equal vectors are searched once and stand for their smallest ids, which is exact for the k nearest.
Cells are cut into blocks of bounded size on both sides, so a hot cell is never one task.

Defined cases: vectors that are null, zero, of another length than the most frequent one or that
hold null or non-finite components take no part, nor do rows without an id; rows that repeat an id
count once, with the smallest vector; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.session import cut, written

BLOCK = 16
#: Vectors and queries of one task's group at most, on average.
CELL_ROWS, QUERY_ROWS = 4096, 4096


@dataclass(frozen=True)
class Index:
    """Everything here is bounded by the sample: it is shipped to tasks."""

    norm: float
    rotation: np.ndarray
    centres: np.ndarray
    probes: int
    sample_ids: np.ndarray
    sample: np.ndarray
    sample_cells: np.ndarray
    k: int

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return (np.column_stack([x, last]) @ self.rotation).astype(np.float32)


def matrix(column) -> np.ndarray:
    """Rows of a list column of equal lengths in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def valid_vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, vector: one row for each id whose vector takes part."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    held = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    held = held.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))
    return held.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def equal_classes(vectors: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """(rep, vector) of each distinct vector, and (rep, vec_id) of its ``keep`` smallest ids.

    Ids are thinned over ever fewer salts, so the copies of one vector never meet in one task.
    """
    reps = vectors.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    reps = written(reps, "vectors")
    ids = vectors.select("vec_id", F.xxhash64("vector").alias("key"), "vector")
    several = reps.where("n > 1").select("vector", F.xxhash64("vector").alias("key"))
    ids = ids.join(several, ["key", "vector"], "left_semi")
    for salts in (64, 8, 1):
        spot = Window.partitionBy("key", "vector", F.pmod(F.xxhash64("vec_id"), F.lit(salts))).orderBy("vec_id")
        ids = ids.withColumn("place", F.row_number().over(spot)).where(F.col("place") <= keep).drop("place")
    named = ids.join(reps.where("n > 1").select("vector", "rep"), "vector").select("rep", "vec_id")
    return reps.select("rep", "vector"), named.union(reps.where("n = 1").select("rep", F.col("rep").alias("vec_id")))


def fit_index(reps: DataFrame, k: int, sample_rows: int = 16384, wanted: float = 0.985, seed: int = 7) -> Index | None:
    """Fit a fourth of the root of n cells on about ``sample_rows`` vectors, at least four a cell; None without vectors.

    The probes are those that ``wanted`` of the sample's own near pairs need, at the depth that
    corresponds to k among all vectors. At most ``sample_rows`` of the sample go along as first limits.
    """
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    n, top = reps.agg(F.count("*"), F.max(norm)).first()
    if not n:
        return None
    lists = max(1, int(np.sqrt(n) / 4))
    rows = max(sample_rows, 4 * lists)
    picked = reps.where(F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, rows / n)))
    got = picked.select("rep", "vector").limit(2 * rows).toArrow()
    if not got.num_rows:
        got = reps.select("rep", "vector").limit(rows).toArrow()
    order = np.argsort(got.column("rep").to_numpy())
    ids, sample = got.column("rep").to_numpy()[order], matrix(got.column("vector"))[order]
    r = np.random.default_rng(seed)
    width = sample.shape[1] + 1
    rotation = np.linalg.qr(r.standard_normal((width, width)))[0]
    index = Index(float(np.sqrt(top)), rotation, np.zeros((0, width)), 1, ids, sample, np.zeros(0, int), k)
    points = index.lift(sample, False)
    centres = points[r.permutation(len(points))[: min(lists, len(points))]].copy()
    for _ in range(8):
        cell = cells(points, centres)
        sums = np.zeros_like(centres, dtype=np.float64)
        np.add.at(sums, cell, points)
        counts = np.bincount(cell, minlength=len(centres))
        full = counts > 0
        centres[full] = (sums[full] / counts[full, None]).astype(np.float32)
    cell = cells(points, centres)
    asked = r.permutation(len(sample))[:512]
    score = sample[asked] @ sample.T
    score[np.arange(len(asked)), asked] = -np.inf
    depth = int(np.clip(np.ceil(k * len(sample) / n), 1, max(1, len(sample) - 1)))
    near = np.argpartition(-score, depth - 1, axis=1)[:, :depth]
    ranked = probed(index.lift(sample[asked], True), centres, len(centres))
    place = np.empty_like(ranked)
    np.put_along_axis(place, ranked, np.arange(len(centres))[None, :].repeat(len(asked), 0), axis=1)
    need = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
    probes = int(need[min(len(need) - 1, int(np.ceil(wanted * len(need))))]) + 1
    limits = np.sort(r.permutation(len(sample))[:sample_rows])
    return Index(index.norm, rotation, centres, probes, ids[limits], sample[limits], cell[limits], k)


def cells(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(64, (8 << 20) // len(centres))
    parts = [probed(points[lo : lo + step], centres, 1)[:, 0] for lo in range(0, len(points), step)]
    return np.concatenate([np.zeros(0, int), *parts])


def probed(points: np.ndarray, centres: np.ndarray, count: int) -> np.ndarray:
    """The nearest ``count`` cells of each point, nearest first."""
    far = (centres * centres).sum(axis=1)[None, :] - 2 * (points @ centres.T)
    if count == 1:
        return far.argmin(axis=1)[:, None]
    return np.argsort(far, axis=1, kind="stable")[:, :count]


def _placed(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = cells(index.lift(matrix(b.column("vector")), False), index.centres)
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("vector"), pa.array(cell.astype(np.int32))], ["rep", "vector", "cell"])

    return run


def _asked(index: Index, probes: int):
    """Queries with their cells and the k-th best score among the sample's other rows in those cells.

    That bound is never above what the cells themselves hold, so their scan finds k rows at least
    wherever the sample has so many in them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(lo, 256) for lo in range(0, b.num_rows, 256)):
                x, ids = matrix(part.column("vector")), part.column("vec_id").to_numpy()
                near = probed(index.lift(x, True), index.centres, probes)
                visited = np.zeros((len(x), len(index.centres)), bool)
                np.put_along_axis(visited, near, True, axis=1)
                score = np.where(visited[:, index.sample_cells] & (ids[:, None] != index.sample_ids[None, :]), x @ index.sample.T, -np.inf)
                bound = np.full(len(x), -np.inf)
                if score.shape[1] >= index.k:
                    bound = -np.partition(-score, index.k - 1, axis=1)[:, index.k - 1]
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("vector"), pa.array(list(near.astype(np.int32)), pa.list_(pa.int32())), pa.array(bound)],
                    ["vec_id", "vector", "cells", "bound"],
                )

    return run


def scan(query: np.ndarray, bound: np.ndarray, points: np.ndarray, k: int, error: float = 2.1, tally: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) pairs that may belong to the k nearest, by blocks of rotated columns.

    ``bound`` is each query's squared distance limit. After d of D columns the scaled partial
    distance estimates the whole one; a pair is abandoned once it exceeds the limit by the factor
    (1 + error / sqrt(d)) ** 2. The limit falls to the k-th nearest as chunks of points are done.
    ``tally`` gathers (pairs, pairs that reach the last block) for each chunk.
    """
    width = query.shape[1]
    limit = bound.copy()
    best = np.full((len(query), k), np.inf, np.float32)
    out_q, out_p = [], []
    for lo in range(0, len(points), 512):
        part = points[lo : lo + 512]
        d = min(BLOCK, width)
        a, b = query[:, :d], part[:, :d]
        first = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
        q, p = np.nonzero(first * (width / d) <= limit[:, None] * (1 + error / np.sqrt(d)) ** 2)
        far = first[q, p]
        reached = len(q) if d >= width else 0
        while d < width and len(q):
            e = min(d + BLOCK, width)
            reached = len(q) if e == width else reached
            gap = query[q, d:e] - part[p, d:e]
            far = far + (gap * gap).sum(axis=1)
            d = e
            alive = far * (width / d) <= limit[q] * ((1 + error / np.sqrt(d)) ** 2 if d < width else 1 + 1e-5)
            q, p, far = q[alive], p[alive], far[alive]
        if tally is not None:
            tally.append((first.size, reached))
        if len(q):
            out_q.append(q)
            out_p.append(p + lo)
            heads, starts, counts = np.unique(q, return_index=True, return_counts=True)
            block = np.full((len(heads), int(counts.max())), np.inf, np.float32)
            block[np.repeat(np.arange(len(heads)), counts), np.arange(len(q)) - np.repeat(starts, counts)] = far
            best[heads] = np.sort(np.concatenate([best[heads], block], axis=1), axis=1)[:, :k]
            limit[heads] = np.minimum(limit[heads], best[heads, -1] * (1 + 1e-5))
    if not out_q:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(out_q), np.concatenate(out_p)


def _searched(index: Index):
    """Scan one block of a cell for one block of queries; one more than k, as a query may meet itself."""
    keep = index.k + 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "rep", "score"]
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        ids, x = left.column("vec_id").to_numpy(), matrix(left.column("vector"))
        reps, y = right.column("rep").to_numpy(), matrix(right.column("vector"))
        points = index.lift(y, False)
        found = []
        for lo in range(0, len(x), 256):
            part = x[lo : lo + 256]
            bound = left.column("bound").to_numpy()[lo : lo + 256]
            limit = (index.norm**2 + (part * part).sum(axis=1) - 2 * bound) * (1 + 1e-5) + 1e-6
            q, p = scan(index.lift(part, True), limit, points, keep)
            if not len(q):
                continue
            score = np.einsum("ij,ij->i", part[q], y[p])
            order = np.lexsort((reps[p], -score, q))
            q, p, score = q[order], p[order], score[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            top = place < keep
            found.append((ids[lo + q[top]], reps[p[top]], score[top]))
        if not found:
            return pa.table([pa.array([], t) for t in kinds], names)
        return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(zip(*found), kinds)], names)

    return run


def nearest(rows: DataFrame, k: int = 20, every: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", **fit) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row whose id ``every`` divides."""
    spark = rows.sparkSession
    vectors = valid_vectors(rows, id_column, vector_column)
    widths = vectors.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if widths is None:
        return spark.createDataFrame([], schema)
    vectors = written(vectors.where(F.size("vector") == widths.w), "ids")
    reps, members = equal_classes(vectors, k + 1)
    index = fit_index(reps, k, **fit)
    placed = written(reps.mapInArrow(_placed(index), "rep long, vector array<double>, cell int"), "cells")
    # one count a cell: bounded by the number of lists
    sizes = dict(placed.groupBy("cell").count().collect())
    queries = vectors.where(F.pmod("vec_id", F.lit(every)) == 0)
    results, probes = None, index.probes
    while True:
        asked = written(queries.mapInArrow(_asked(index, probes), "vec_id long, vector array<double>, cells array<int>, bound double"), "asked")
        got = written(_visited(placed, asked, members, index, sizes), "near")
        if probes >= len(index.centres):
            return got if results is None else results.union(got)
        # queries whose cells hold too few rows visit more
        full = got.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
        queries = written(queries.join(full.withColumnRenamed("query_id", "vec_id"), "vec_id", "left_anti"), "short")
        kept = got.join(full, "query_id", "left_semi")
        results = kept if results is None else results.union(kept)
        if queries.isEmpty():
            return results
        probes = min(4 * probes, len(index.centres))


def _visited(placed: DataFrame, asked: DataFrame, members: DataFrame, index: Index, sizes: dict[int, int]) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows within each query's cells."""
    k = index.k
    asked = asked.select("vec_id", "vector", "bound", F.explode("cells").alias("cell"))
    loads = dict(asked.groupBy("cell").count().collect())
    cuts = placed.sparkSession.createDataFrame(
        [(c, -(-sizes[c] // CELL_ROWS), -(-loads.get(c, 1) // QUERY_ROWS)) for c in sizes], "cell int, parts int, asks int"
    )
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = placed.join(F.broadcast(cuts), "cell").withColumn("part", own("rep", "parts")).withColumn("ask", each("asks"))
    left = asked.join(F.broadcast(cuts), "cell").withColumn("ask", own("vec_id", "asks")).withColumn("part", each("parts"))
    keys = ["cell", "part", "ask"]
    found = (
        left.select(*keys, "vec_id", "vector", "bound")
        .groupBy(*keys)
        .cogroup(right.select(*keys, "rep", "vector").groupBy(*keys))
        .applyInArrow(_searched(index), "query_id long, rep long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    found = cut(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place"))
    named = found.join(members, "rep").where("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return named.withColumn("rank", F.row_number().over(last).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
