"""Small helpers of the operators: tables, Arrow text blocks, tokenizer files."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAD = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """At the end of a task, give freed memory back: its Python worker is kept for later tasks, and would hold on to it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors the package's code, once per application, as --py-files would: tasks import it."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if sc.applicationId not in _SHIPPED and package.is_dir():
        path = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(path))
        _SHIPPED.add(sc.applicationId)


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text only, a null text read as the empty one; other columns can't clash with those of an operator."""
    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def id_key(key: str = "doc_id") -> Column:
    """The id for joins: a null one becomes the smallest number, so that null meets null by a plain long key."""
    return F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))


def tokenizer_file(path: str | None = None) -> str:
    """The tokenizer's JSON, read on the driver: a file of fixed size, which the tasks get as a broadcast value."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes, padded by PAD zeros, and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(PAD, np.uint8), np.zeros(len(column) + 1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.zeros(last - first + PAD, np.uint8)
    data[: last - first] = np.frombuffer(column.buffers()[2], np.uint8)[first:last]
    return data, offsets - first


def slices(batch: pa.RecordBatch, column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `size` bytes of text each; a longer row is a run of its own."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    ends = np.cumsum(np.diff(np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]))
    at = 0
    while at < len(col):
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield batch.slice(at, end - at)
        at = end


def lanes(data: np.ndarray) -> np.ndarray:
    """For every byte position the eight bytes from there, as one little-endian number; data ends with padding."""
    return np.ndarray((len(data) - 8,), "<u8", buffer=data, strides=(1,))


def mix(x: np.ndarray, factor: int) -> np.ndarray:
    """Spread all bits of 64-bit numbers over one another; each step can be undone, so it loses nothing."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(factor)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of byte ranges of any length."""
    view = lanes(data)
    one, two = mix(lengths.astype(np.uint64), 0x9E3779B97F4A7C15), mix(lengths.astype(np.uint64), 0xD6E8FEB86659FD93)
    some, k = np.arange(len(starts)), 0
    while len(some):
        left = lengths[some] - 8 * k
        some, left = some[left > 0], left[left > 0]
        if not len(some):
            break
        lane = view[starts[some] + 8 * k]
        cut = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        lane = np.where(left >= 8, lane, lane & ((np.uint64(1) << (cut & np.uint64(63))) - np.uint64(1)))
        one[some] = mix(one[some] ^ (lane * np.uint64(0xA0761D6478BD642F)), 0x9E3779B97F4A7C15)
        two[some] = mix((two[some] + np.uint64(0x632BE59BD9B4E019)) ^ (lane * np.uint64(0xE7037ED1A0B428DB)), 0xD6E8FEB86659FD93)
        k += 1
    return one, two


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each of the ranges, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts.astype(np.int64) - before, lengths) + np.arange(total)
