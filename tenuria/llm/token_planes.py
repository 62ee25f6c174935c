"""Token-id files as shuffled planes.

Ids of all documents in doc_id order are cut into blocks of a fixed number of ids. A block is transposed into byte planes
(all low bytes, then all next bytes, ...) or bit planes, each plane is compressed by zstandard, and one Parquet row holds
the planes together with the block's entry of the index: part, block, first id, documents and lengths of their pieces.
A reader that needs a few documents finds their blocks by the index columns alone.

Defined results: a null text is empty and holds the end id only; repeated doc_ids stay apart, ordered by text; a null
doc_id sorts first; an empty table gives an empty file. Only the key and the text column are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenuria.llm.frames import slices, texts, utf8
from tenuria.llm.wordmemo import library_memo

BLOCK, OPENING = 1 << 16, 256
FILE = pa.schema([
    ("part", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("layout", pa.string()),
    ("planes", pa.list_(pa.binary())), ("seq", pa.int64()), ("opens", pa.bool_()), ("closes", pa.bool_()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
])
DDL = ("part long, block long, first long, n_ids long, layout string, planes array<binary>, seq long, opens boolean, "
       "closes boolean, doc_ids array<long>, lengths array<long>")


def to_planes(ids: np.ndarray, layout: str) -> list[bytes]:
    """Compressed planes of a block, lowest first; planes above the largest id are left out."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()).bit_length() if len(ids) else 0
    if layout == "byte":
        planes = [raw[:, k].tobytes() for k in range(max(1, -(-top // 8)))]
    elif layout == "bit":
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, k]).tobytes() for k in range(max(1, top))]
    else:
        raise ValueError(f"no such layout: {layout}")
    return [packer.compress(p) for p in planes]


def from_planes(planes: list[bytes], n: int, layout: str) -> np.ndarray:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    out = np.zeros((n, 4), np.uint8)
    if layout == "byte":
        for k, p in enumerate(planes):
            out[:, k] = np.frombuffer(unpack.decompress(p), np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            bits[:, k] = np.unpackbits(np.frombuffer(unpack.decompress(p), np.uint8))[:n]
        out = np.packbits(bits, axis=1, bitorder="little")
    return out.reshape(-1).view("<u4")


def write_planes(docs: DataFrame, path: str, config: str, end_id: int = 0, block: int = BLOCK, layout: str = "byte", parts: int | None = None) -> None:
    """Encode whole texts by the tokenizers library, add `end_id` to each, write the planes. parts: ranges of doc_id and text."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(config)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo, part = library_memo(held.value), TaskContext.get().partitionId()
        state = {"block": 0, "first": 0, "seq": 0, "opens": False}
        ids, keys, lengths = np.zeros(0, np.uint32), [], []

        def row(n: int) -> pa.RecordBatch:
            """The first n ids, of the documents that begin or go on in them."""
            nonlocal ids, keys, lengths
            ends = np.cumsum(lengths)
            k = int(np.searchsorted(ends, n, side="left")) + 1
            rest = int(ends[k - 1]) - n
            own = [*lengths[: k - 1], lengths[k - 1] - rest]
            out = {"part": part, **{x: state[x] for x in ("block", "first", "seq", "opens")}, "n_ids": n, "layout": layout, "planes": to_planes(ids[:n], layout), "closes": rest == 0, "doc_ids": keys[:k], "lengths": own}
            state.update(block=state["block"] + 1, first=state["first"] + n, seq=state["seq"] + k - (rest > 0), opens=rest > 0)
            ids = ids[n:]
            keys, lengths = keys[k - (rest > 0) :], ([rest] if rest else []) + lengths[k:]
            return pa.RecordBatch.from_pylist([out], schema=FILE)

        for batch in batches:
            for some in slices(batch, "text"):
                got, n = memo.encode(*utf8(some.column(1)))
                ends = np.cumsum(n + 1)
                more = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.uint32)
                body = np.ones(len(more), bool)
                body[ends - 1] = False
                more[body] = got
                ids = np.concatenate([ids, more])
                keys += some.column(0).to_pylist()
                lengths += (n + 1).tolist()
                while len(ids) >= block:
                    yield row(block)
        if len(ids):
            yield row(len(ids))

    # Texts of one doc_id, or of none, are dealt by how they begin, which agrees with their order.
    ranged = texts(docs).repartitionByRange(parts, "doc_id", F.substring("text", 1, OPENING)).sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(blocks, DDL).write.option("compression", "uncompressed").parquet(path)


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (binary: little-endian unsigned 32-bit numbers)."""
    rows = spark.read.schema(DDL).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row of two numbers per part, at most as many as the writer's ranges: small enough to broadcast.
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = rows.join(F.broadcast(parts), "part")

    def pieces(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                    n = np.array(r["lengths"], np.int64)
                    part_of = np.zeros(len(n), bool)
                    part_of[0] |= r["opens"]
                    part_of[-1] |= not r["closes"]
                    ends = np.cumsum(n)
                    pick = np.flatnonzero(part_of != whole)
                    if len(pick):
                        ids = from_planes(r["planes"], r["n_ids"], r["layout"])
                        yield pa.RecordBatch.from_pydict({
                            "part": pa.array([r["part"]] * len(pick), pa.int64()), "seq": pa.array(r["seq"] + pick, pa.int64()),
                            "doc_id": pa.array([r["doc_ids"][i] for i in pick], pa.int64()), "start": pa.array(r["base"] + r["first"] + ends[pick] - n[pick], pa.int64()),
                            "ids": pa.array([ids[ends[i] - n[i] : ends[i]].tobytes() for i in pick], pa.binary()),
                        })

        return placed.mapInArrow(run, "part long, seq long, doc_id long, start long, ids binary")

    cut = pieces(False).groupBy("part", "seq").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.array_sort(F.collect_list(F.struct("start", "ids"))).alias("all"))
    joined = cut.select("doc_id", "start", F.aggregate("all", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    return pieces(True).select("doc_id", "start", "ids").unionByName(joined)
