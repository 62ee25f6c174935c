"""Corpus pipeline: language ID, near-duplicate removal, removal of repeated passages, decontamination, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows the stage before has kept, and returns a DataFrame, which is written
as Parquet and reread as the next one's docs. All but the last return the columns of documents.

Defined results: rows whose text is null or has no letter go in the first stage; each row without doc_id is a document of its
own, which comes after all with one; rows that repeat a doc_id count as one document; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenuria.llm import containment, prefix_bpe, simhash, string_kernel, suffix_levels
from tenuria.llm.frames import ship, table, tokenizer_file
from tenuria.session import stored

KEY = "row_key"
NO_ID = suffix_levels.NO_ID


def packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct, beside which a stage's own columns can't clash with those of docs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, the only ones that are "und": any other gets a known language, whatever its score. The
    model learns from a bounded sample of the labelled rows."""
    model = string_kernel.fit(docs.select("doc_id", "text", "lang"))
    if model is None:  # nothing is labelled, so only texts without letters are rejected
        return docs.where(string_kernel.letters(F.col("text")) != "")
    rows = keyed(docs)
    texts = rows.select(KEY, F.col("doc.lang").alias("lang"), F.coalesce(F.col("doc.text"), F.lit("")).alias("text"))
    known = string_kernel.identify(texts, model, keep=(KEY, "lang")).where(F.col("lang_pred") != string_kernel.UNKNOWN).select(KEY).distinct()
    return rows.join(known, KEY, "left_semi").select("doc.*")


def keyed(docs: DataFrame) -> DataFrame:
    """doc and row_key: the doc_id, or for each row without one a number of its own above all doc_ids, fixed by storing those rows."""
    doc_id = F.col("doc.doc_id").cast("long")
    top, n = docs.agg(F.max(F.col("doc_id").cast("long")), F.count_if(F.col("doc_id").cast("long").isNull())).first()
    rows = packed(docs)
    if not n:
        return rows.withColumn(KEY, doc_id)
    first = 0 if top is None else top + 1
    if first + n > NO_ID:
        raise ValueError(f"{n} rows without doc_id, but fewer numbers above the largest doc_id, {top}")
    # The id holds the number of the part above 33 bits and the row's place in it below: made dense by the rows of the parts before.
    lost = stored(rows.where(doc_id.isNull()).withColumn(KEY, F.monotonically_increasing_id()))
    part, place = F.shiftright(KEY, 33), F.col(KEY).bitwiseAND(F.lit((1 << 33) - 1))
    starts, at = [], first
    for r in sorted(lost.groupBy(part.alias("part")).count().collect()):
        starts.append((r["part"], at))
        at += r["count"]
    begins = docs.sparkSession.createDataFrame(starts, "key_part long, key_start long")
    lost = lost.join(F.broadcast(begins), part == F.col("key_part")).select("doc", (F.col("key_start") + place).alias(KEY))
    return rows.where(doc_id.isNotNull()).withColumn(KEY, doc_id).unionByName(lost)


def by_key(rows: DataFrame) -> DataFrame:
    """What the operators read, with the key as the id."""
    return rows.select(F.col(KEY).alias("doc_id"), F.col("doc.text").alias("text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of near duplicates the document with the smallest doc_id, or one row where none has a doc_id."""
    rows = keyed(docs)
    found = simhash.near_duplicates(by_key(rows))
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(KEY)).distinct()
    return rows.join(kept, KEY, "left_semi").select("doc.*")


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts 50-byte strings that a smaller doc_id also has; characters of which a byte is cut go whole. Documents of which
    nothing is left go. Rows without doc_id come after all doc_ids, each a document of its own."""
    rows = keyed(docs)
    cut = suffix_levels.remove_repeats(by_key(rows), text=True).select(F.col("doc_id").alias(KEY), F.col("text").alias("left_text"))
    rest = rows.withColumn("doc", F.col("doc").dropFields("text")).dropDuplicates([KEY])
    own = {"text": F.col("left_text"), "n_chars": F.length("left_text").cast("long")}
    return cut.where(F.trim("left_text") != "").join(rest, KEY).select(*[own.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold 80 % of the five-word shingles of a benchmark item, or all words of a shorter one in a row."""
    rows = keyed(docs)
    found = containment.contained(by_key(rows), table(spark, sf_dir, "benchmark"), short=True).select(F.col("doc_id").alias(KEY)).distinct()
    return rows.join(found, KEY, "left_anti").select("doc.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of the remaining texts."""
    coded = prefix_bpe.encode_decode(docs, tokenizer_file())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]

#: SQL can't express the kernel, the components of links nor the encoding; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and reread."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
