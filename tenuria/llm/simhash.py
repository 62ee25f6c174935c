"""SimHash near duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two halves. Fingerprints that differ in three bits at most differ in one bit at most in one
of the halves, so every fingerprint looks up the 33 values of that small Hamming ball in the table of each half, and the
whole distance of each match is verified. Documents with one fingerprint are one row of the tables, so copies are never
paired; components of links come from joins.

Defined results: a null text is empty; no words give fingerprint zero, which links like any other; ties do not set a bit;
repeated rows share a component; component_id is the smallest non-null doc_id reachable, null if there is none.
Only the key and the text column are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenuria.llm.components import components
from tenuria.llm.frames import texts, trim
from tenuria.session import stored

WORDS, SEED, DISTANCE = 3, 42, 3
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of the word shingles; bytes.split() cuts at the six ASCII white-space characters."""
    import xxhash

    parts = text.translate(LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    total, at = np.zeros(64, np.int64), 0
    while at < len(h):  # in parts, as each hash becomes 64 bytes
        some = h[at : at + 65536]
        total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        at += 65536
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (its 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t.as_buffer().to_pybytes()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(marks, np.uint64).view(np.int64))], ["doc_id", "fingerprint"])
        trim()

    return texts(docs).mapInArrow(run, "doc_id long, fingerprint long")


def half(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if k else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def links(marks: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """a < b: distinct fingerprints that differ in `distance` bits at most (3 or fewer: one bit per half is then enough)."""
    if not 0 <= distance <= 3:
        raise ValueError("two halves with balls of one bit find distances up to 3")
    fp = F.col("fingerprint")
    ball = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    sides = F.array(*[F.struct(F.lit(k).alias("side"), half(fp, k).alias("value")) for k in (0, 1)])
    tables = marks.select(fp.alias("b"), F.explode(sides).alias("s")).select("b", (F.col("s.value") * 2 + F.col("s.side")).alias("bucket"))
    probes = marks.select(fp.alias("a"), F.explode(sides).alias("s")).select("a", "s", F.explode(ball).alias("flip")).select(
        "a", (F.col("s.value").bitwiseXOR(F.col("flip")) * 2 + F.col("s.side")).alias("bucket"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    # Spark takes the probes for as small as the file they are exploded from, and would broadcast them.
    return probes.hint("merge").join(tables, (probes["bucket"] == tables["bucket"]) & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (long), component_id."""
    marks = stored(fingerprints(docs))
    own = stored(marks.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    labels = components(links(own, distance), "a", "b").withColumnRenamed("vertex", "fingerprint")
    placed = own.join(labels, "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint"))
    first = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    by_mark = placed.join(first, "label").select("fingerprint", "component_id")
    return marks.join(by_mark, "fingerprint").select("doc_id", "fingerprint", "component_id")
