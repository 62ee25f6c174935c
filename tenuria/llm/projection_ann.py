"""Nearest neighbours by few stable projections and kd-trees.

Unit vectors are projected on PROJECTIONS random normal directions (2-stable: a projected squared distance is the true one
times a chi-square variable). A kd-tree of the projections, split at medians of a bounded sample, deals all rows into
leaves; in a leaf a smaller kd-tree orders its buckets. A search visits buckets by their projected distance, verifies the
true cosine of the rows in them, and stops when the chi-square test holds: a vector as near as the k-th found would, with
probability CONFIDENCE, have a smaller projected distance than all that is left (by more than EDGE, the rounding of unit vectors). A query first searches its own leaf, and then
those leaves that the test with its k-th distance there leaves open.

Equal vectors are one row of the index with their k + 1 smallest ids, all that can be among k results; equal queries are one
search. The score is dot / (norm * norm) of the original vectors, at most 1; equal scores go by the smaller id, inside a leaf too. Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those
of another length than most have (of equally frequent lengths, the shortest counts); fewer candidates than k are all returned;
a repeated id is one candidate, and a query's own id is none; null ids take no part; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenuria.session import stored

PROJECTIONS, CONFIDENCE = 8, 0.95
LEAF_ROWS, BUCKET_ROWS, SAMPLE = 4096, 64, 20_000
SEED = 20240229
EDGE = 1e-12


def chi_square(x: float, m: int) -> float:
    """Distribution function for an even number m of degrees of freedom."""
    term = total = 1.0
    for j in range(1, m // 2):
        term *= x / 2 / j
        total += term
    return 1 - math.exp(-x / 2) * total


def quantile(p: float, m: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


def directions(size: int, m: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, m))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Cells:
    """The upper kd-tree: 2 ** depth leaves, with the box of each in projected space."""

    def __init__(self, sample: np.ndarray, depth: int):
        m = sample.shape[1]
        self.depth, self.axis, self.cut = depth, np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        low, high, rows = {1: np.full(m, -np.inf)}, {1: np.full(m, np.inf)}, {1: np.arange(len(sample))}
        for node in range(1, 1 << depth):
            own = sample[rows[node]]
            k = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(own) else 0
            cut = float(np.median(own[:, k])) if len(own) else 0.0
            self.axis[node], self.cut[node] = k, cut
            right = own[:, k] > cut if len(own) else np.zeros(0, bool)
            for child, side in ((2 * node, ~right), (2 * node + 1, right)):
                rows[child], low[child], high[child] = rows[node][side], low[node].copy(), high[node].copy()
            high[2 * node][k] = min(high[node][k], cut)
            low[2 * node + 1][k] = max(low[node][k], cut)
        self.low = np.array([low[(1 << depth) + i] for i in range(1 << depth)])
        self.high = np.array([high[(1 << depth) + i] for i in range(1 << depth)])

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - (1 << self.depth)

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of a projected point to the box of every leaf."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (gap**2).sum(axis=1)


class Leaf:
    """Rows of one leaf (original vectors, their smallest ids) in buckets of a kd-tree over the projections of their unit vectors."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, way: np.ndarray, bucket: int = BUCKET_ROWS):
        projected = unit(vectors) @ way
        parts, done = [np.arange(len(vectors))], []
        while parts:
            rows = parts.pop()
            own = projected[rows]
            k = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            if len(rows) <= bucket:
                done.append(rows)
                continue
            order = np.argsort(own[:, k], kind="stable")
            parts += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
        self.rows = done
        self.vectors, self.ids, self.norms = vectors, ids, np.linalg.norm(vectors, axis=1)
        self.low = np.array([projected[r].min(axis=0) for r in done])
        self.high = np.array([projected[r].max(axis=0) for r in done])

    def search(self, query: np.ndarray, point: np.ndarray, k: int, bound: float, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k best; bound: squared distance of the k-th known so far; limit: of the stopping test."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        far = (gap**2).sum(axis=1)
        order = np.argsort(far, kind="stable")
        norm = np.linalg.norm(query[None, :], axis=1)[0]
        found, cosine = np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, len(order), 4):
            if far[order[at]] > limit * bound + EDGE:
                break
            rows = np.concatenate([self.rows[b] for b in order[at : at + 4]])
            size = self.norms[rows] * norm
            if len(found) == k:  # a matrix product rounds by more than the score, but by far less than EDGE
                likely = (self.vectors[rows] @ query) / size >= cosine.min() - EDGE
                rows, size = rows[likely], size[likely]
            score = np.clip((self.vectors[rows] * query).sum(axis=1) / size, -1, 1)
            found, cosine = np.append(found, rows), np.append(cosine, score)
            if len(found) > k:
                best = np.lexsort((self.ids[found], -cosine))[:k]
                found, cosine = found[best], cosine[best]
            if len(found) == k:
                bound = min(bound, max(0.0, 2 - 2 * cosine.min()))
        return found, cosine


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, vector (array of double) of the rows that take part."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    d = d.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(finite & F.exists("v", lambda x: x != 0))
    sizes = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return d.where(F.size("v") == (sizes[0].n if sizes else 0)).withColumnRenamed("v", "vector")


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """key (two hashes), vector, ids (its `keep` smallest): reduced in every task, then in parts, then as a whole."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % 64
        for batch in batches:
            best: dict[tuple[int, int], tuple[int, list[int]]] = {}
            for i, (a, b, vec_id) in enumerate(zip(*(batch.column(j).to_pylist() for j in (0, 1, 2)), strict=True)):
                ids = best.setdefault((a, b), (i, []))[1]
                ids.append(vec_id)
                if len(ids) > 8 * keep:
                    ids[:] = sorted(set(ids))[:keep]
            pick = pa.array([i for i, _ in best.values()])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), batch.column(3).take(pick), pa.array([sorted(set(ids))[:keep] for _, ids in best.values()], pa.list_(pa.int64())), pa.array([part] * len(pick), pa.int32())], ["h1", "h2", "vector", "ids", "part"])

    fewest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids")
    d = rows.select(F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"), "vec_id", "vector").mapInArrow(local, "h1 long, h2 long, vector array<double>, ids array<long>, part int")
    return d.groupBy("h1", "h2", "part").agg(F.first("vector").alias("vector"), fewest).groupBy("h1", "h2").agg(F.first("vector").alias("vector"), fewest)


def neighbours(rows: DataFrame, every: int = 50, k: int = 5, m: int = PROJECTIONS, confidence: float = CONFIDENCE, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row whose id is divisible by `every`."""
    spark = rows.sparkSession
    d = usable(rows)
    index = stored(distinct_vectors(d, k + 1))
    n = index.count()
    sample = np.array([r.vector for r in index.orderBy("h1").limit(SAMPLE).select("vector").collect()], np.float64)
    size = sample.shape[1] if len(sample) else 1
    depth = max(0, min(math.ceil(math.log2(max(1, n) / leaf_rows)), int(math.log2(max(1, len(sample))) - 4)))
    way = directions(size, m)
    cells = Cells(unit(sample) @ way if len(sample) else np.zeros((0, m)), depth)
    limit = quantile(confidence, m)
    held = spark.sparkContext.broadcast((way, cells))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        way, cells = held.value
        for batch in batches:
            leaf = cells.leaf(unit(matrix(batch.column(2))) @ way) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64())], names=[*batch.schema.names, "leaf"])

    points = stored(index.mapInArrow(placed, "h1 long, h2 long, vector array<double>, ids array<long>, leaf long"))
    asked = d.where(F.col("vec_id") % every == 0).select("vec_id", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")).distinct()
    home = stored(points.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select(
        "leaf", "h1", "h2", F.col("vector").alias("query"), F.lit(float("inf")).alias("bound")))

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        way, _ = held.value
        out: list[tuple] = []
        if queries.num_rows and rows.num_rows:
            ids = rows.column("ids").to_pylist()
            tree = Leaf(matrix(rows.column("vector").combine_chunks()), np.array([i[0] for i in ids], np.int64), way)
            wanted = matrix(queries.column("query").combine_chunks())
            points_ = unit(wanted) @ way
            for h1, h2, q, point, bound in zip(queries.column("h1").to_pylist(), queries.column("h2").to_pylist(), wanted, points_, queries.column("bound").to_pylist(), strict=True):
                found, cosine = tree.search(q, point, k + 1, bound, limit)
                out += [(h1, h2, vec_id, float(c)) for i, c in zip(found.tolist(), cosine.tolist(), strict=True) for vec_id in ids[i]]
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["h1", "h2", "vec_id", "score"])

    found_ddl = "h1 long, h2 long, vec_id long, score double"

    def searched(queries: DataFrame) -> DataFrame:
        return stored(queries.groupBy("leaf").cogroup(points.groupBy("leaf")).applyInArrow(search, found_ddl))

    first = searched(home)
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id"))
    kth = first.select("h1", "h2", "score", place.alias("place")).where(F.col("place") <= k + 1).groupBy("h1", "h2").agg(
        F.when(F.count("*") > k, 2 - 2 * F.min("score")).otherwise(float("inf")).alias("bound"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        way, cells = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            points_ = unit(matrix(batch.column(3))) @ way
            for i in range(batch.num_rows):
                bound = max(0.0, batch.column(4)[i].as_py())
                leaves = np.flatnonzero(cells.distances(points_[i]) <= limit * bound + EDGE)
                leaves = leaves[leaves != batch.column(0)[i].as_py()]
                if len(leaves):
                    one = batch.slice(i, 1).take(pa.array(np.zeros(len(leaves), np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), *one.columns[1:]], names=one.schema.names)

    open_ = home.drop("bound").join(kth, ["h1", "h2"]).select("leaf", "h1", "h2", "query", "bound").mapInArrow(others, "leaf long, h1 long, h2 long, query array<double>, bound double")
    best = first.unionByName(searched(open_)).withColumn("place", place).where(F.col("place") <= k + 1)
    rank = F.row_number().over(Window.partitionBy("query_id", "h1", "h2").orderBy(F.desc("score"), "vec_id"))
    return asked.withColumnRenamed("vec_id", "query_id").join(best, ["h1", "h2"]).where("query_id <> vec_id").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
