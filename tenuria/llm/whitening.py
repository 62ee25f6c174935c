"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries become whole numbers floor(scale * c) + shift, so all sums are exact. The fit list holds each distinct vector once; tasks add up its sums
and products, Spark adds those of the tasks, and the driver gets one number per pair of dimensions. The scatter n * sum(xx') - SS' is centred
in whole numbers and then factored as L L' with pivoting. Jacobi rotations make the columns of L orthogonal: their squared norms are
the eigenvalues, the columns over their norms the components. The factor and the check of the result use extended precision, so that small
eigenvalues keep their digits beside large ones.

Defined results: vectors that are null, empty, of another length than most (ties to the shorter length) or hold null or non-finite
entries or entries beyond 2^40 take no part; directions without variance (some 1e-12 of the largest) are no components, so fewer than two different vectors have none and give no
rows; rows that repeat a vector or an id each get theirs; a deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Entries beyond it are no embeddings; below it products of two, added over a block, stay exact in steps of 2^53.
LARGEST = float(1 << 40)
BLOCK = 4096
DIGITS = 1e5


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: tuple[int, ...]  # of y = x - shift
    components: np.ndarray  # rows
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def usable(frame: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector takes part, by its own entries."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) <= LARGEST))
    return frame.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & good)


def dimension(vectors: DataFrame, vector: str) -> int:
    """The most frequent length; 0 without vectors."""
    found = vectors.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return int(found["d"]) if found else 0


def whole(column: pa.Array, d: int, scale: int) -> np.ndarray:
    """y = floor(scale * c) as numbers of 64 bits, rows x d."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).astype(np.int64).reshape(len(column), d)


def exact_products(y: np.ndarray) -> np.ndarray:
    """y'y: in halves of 24 bits, whose sums over a block floats hold exactly, as Python numbers."""
    if np.abs(y).max(initial=0) < 1 << 20:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    low = y & ((1 << 20) - 1)
    parts = [low.astype(np.float64), ((y >> 20) & ((1 << 20) - 1)).astype(np.float64), (y >> 40).astype(np.float64)]
    total = np.zeros((y.shape[1],) * 2, object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            total = total + (a.T @ b).astype(np.int64).astype(object) * (1 << (20 * (i + j)))
    return total


def distinct_vectors(vectors: DataFrame, vector: str, d: int, scale: int) -> DataFrame:
    """Each distinct y once, packed as 16-bit numbers where all of its entries fit, else 64-bit ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = whole(batch.column(0), d, scale)
            small = np.abs(y).max(axis=1, initial=0) < 1 << 15
            yield pa.RecordBatch.from_arrays([pa.array([(r.astype("<i2") if s else r).tobytes() for r, s in zip(y, small.tolist(), strict=True)], pa.binary())], ["y"])

    return vectors.select(F.col(vector).cast("array<double>")).mapInArrow(run, "y binary").distinct()


def sums(packed: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """n, sums of y and of its products over the fit list, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = batch.column(0).slice(at, BLOCK).to_pylist()
                y = np.array([np.frombuffer(r, "<i2" if len(r) == 2 * d else "<i8") for r in rows], np.int64)
                n, one, two = n + len(y), one + y.sum(axis=0).astype(object), two + exact_products(y)
        i, j = np.triu_indices(d)
        rows = [(-1, -1, n), *[(-1, k, v) for k, v in enumerate(one)], *zip(i.tolist(), j.tolist(), two[i, j], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                          pa.array([str(r[2]) for r in rows])], ["i", "j", "v"])

    parts = packed.mapInArrow(run, "i int, j int, v string")
    found = {(r["i"], r["j"]): int(r["v"]) for r in parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    products = np.zeros((d, d), object)
    for (i, j), v in found.items():
        if i >= 0:
            products[i, j] = products[j, i] = v
    return found.get((-1, -1), 0), [found.get((-1, k), 0) for k in range(d)], products


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L (d x rank) with a = L L'; the pivot of each step is the greatest diagonal entry left, which makes L triangular but for the order of its rows."""
    left, columns = a.copy(), []
    limit = len(a) * np.finfo(a.dtype).eps * max(a.diagonal().max(initial=a.dtype.type(0)), 0.0)
    used: list[int] = []
    for _ in range(len(a)):
        diagonal = left.diagonal().copy()
        diagonal[used] = -1.0
        p = int(np.argmax(diagonal))
        if diagonal[p] <= limit:
            break
        column = left[:, p] / np.sqrt(diagonal[p])
        column[used] = 0.0
        columns.append(column)
        left -= np.outer(column, column)
        used.append(p)
    return np.array(columns).T.reshape(len(a), len(columns))


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor with its columns rotated among each other until they are orthogonal, by falling norm."""
    c = factor.T.copy()  # rows are columns of the factor
    for _ in range(sweeps):
        turned = False
        for i in range(len(c) - 1):
            for j in range(i + 1, len(c)):
                a, b, g = c[i] @ c[i], c[j] @ c[j], c[i] @ c[j]
                if abs(g) <= 1e-15 * np.sqrt(a * b):
                    continue
                turned = True
                z = (b - a) / (2 * g)
                t = (1.0 if z >= 0 else -1.0) / (abs(z) + np.hypot(1.0, z))
                cos = 1 / np.hypot(1.0, t)
                c[i], c[j] = cos * (c[i] - t * c[j]), cos * (t * c[i] + c[j])
        if not turned:
            break
    order = np.argsort(-np.linalg.norm(c, axis=1), kind="stable")
    return c[order].T


def fit(frame: DataFrame, vector: str = "embedding", scale: int = SCALE) -> tuple[Whitening | None, int]:
    """The whitening of all vectors that take part, and their length; None without a direction of variance."""
    vectors = usable(frame, vector)
    d = dimension(vectors, vector)
    if not d:
        return None, d
    n, s, products = sums(distinct_vectors(vectors.where(F.size(vector) == d), vector, d, scale), d)
    centred = np.array([[(n * products[i, j] - s[i] * s[j]) for j in range(d)] for i in range(d)], object)
    covariance = np.array([[np.longdouble(str(v)) / np.longdouble(str(n * n)) for v in row] for row in centred], np.longdouble).reshape(d, d)
    rotated = one_sided_jacobi(pivoted_cholesky(covariance).astype(float))
    norms = np.linalg.norm(rotated, axis=0)
    # What the factor leaves out is rounding of the largest entries; a component has to stand far above it.
    kept = norms**2 > DIGITS * d * np.finfo(np.longdouble).eps * max(covariance.diagonal().max(initial=np.longdouble(0)), 0)
    if not kept.any():
        return None, d
    components, values = (rotated / norms).T[kept], norms[kept] ** 2
    k = min(COMPONENTS, len(values))
    w = components[:k] / np.sqrt(values[:k])[:, None]
    error = float(np.abs(w @ covariance @ w.T - np.eye(k)).max())
    return Whitening(n, tuple(s), components, values, float(sum(centred[i, i] for i in range(d)) / (n * n)), error), d


def whitened(frame: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """Key, component, n, deviation, whitened, explained, identity_error: a row for each component of each vector that takes part."""
    schema = f"{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model, d = fit(frame, vector, scale)
    if model is None:
        return frame.sparkSession.createDataFrame([], schema)
    n, s = model.n, np.array(model.sums, object)
    k = min(components, len(model.eigenvalues))
    w = (model.components[:k] / np.sqrt(model.eigenvalues[:k])[:, None]).T
    explained, mean = model.eigenvalues[:k] / model.trace, np.array([v / n for v in model.sums])

    def deviations(y: np.ndarray) -> list[int | None]:
        far = n * int(np.abs(y).max(initial=0)) + max(abs(v) for v in model.sums)
        if far * far * d < 1 << 63:
            return (((n * y - s.astype(np.int64)) ** 2).sum(axis=1)).tolist()
        exact = ((n * y.astype(object) - s) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = whole(batch.column(1), d, scale)
            m = len(y)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                 pa.array(deviations(y), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(((y - mean) @ w).reshape(-1)),
                 pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error))],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    rows = usable(frame, vector).where(F.size(vector) == d)
    return rows.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector)).mapInArrow(run, schema)
