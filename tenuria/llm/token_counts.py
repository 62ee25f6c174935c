"""Token counts with a digest cache.

The cache is a Parquet folder of (tokenizer, digest, n_tokens): the SHA-256 of the tokenizer file and of the content. A run
joins its documents to it by digest, encodes one document of each digest that is missing, and appends those counts. The
content is normalised only as far as no count can change: a null text is the empty text.

Defined results: repeated rows give repeated rows; an empty table adds nothing. Only the key and the text column are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenuria.llm.frames import slices, texts, utf8
from tenuria.llm.wordmemo import library_memo
from tenuria.session import stored

CACHE = "tokenizer string, digest string, n_tokens long"


def stored_counts(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """digest, n_tokens of one tokenizer; none if the folder does not exist. A digest appended twice counts once."""
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache: str, config: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; counts of new contents are in `cache` when this returns."""
    spark = docs.sparkSession
    version = hashlib.sha256(config.encode()).hexdigest()
    held = spark.sparkContext.broadcast(config)
    d = texts(docs).withColumn("digest", F.sha2("text", 256))
    known = stored_counts(spark, cache, version)
    # Keyed by document, so that the text of a hot content does not gather in one task.
    missing = d.groupBy("digest").agg(F.min("doc_id").alias("first_id")).join(known, "digest", "left_anti").withColumnRenamed("digest", "wanted")
    chosen = d.join(missing, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("wanted")), "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = library_memo(held.value)
        for batch in batches:
            for some in slices(batch, "text"):
                _, n = memo.encode(*utf8(some.column(1)))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n.astype(np.int64))], ["digest", "n_tokens"])

    new = chosen.select("digest", "text").mapInArrow(count, "digest string, n_tokens long")
    new.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    # Written first: Spark can then split a hot content of this join among tasks.
    counts = stored(stored_counts(spark, cache, version))
    return d.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest").join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
