"""The operators as registered queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenuria.llm import chat, chosen_path, containment, line_blocks, middle_fill, prefix_bpe, projection_ann, simhash, string_kernel, suffix_levels, token_counts, token_planes, whitening
from tenuria.llm.frames import ship, table, tokenizer_file
from tenuria.session import shared_dir, stored


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/planes-{uuid4().hex}"
    token_planes.write_planes(table(spark, sf_dir, "documents"), path, tokenizer_file())
    return token_planes.read_planes(spark, path).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op2_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_blocks.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = prefix_bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/counts-{uuid4().hex}", tokenizer_file())


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op6_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = string_kernel.fit(docs.where(~held_out()))
    return string_kernel.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    out = stored(chat.formatted(chat.canonical(chat.records(rows))).select("conv_id", "formatted", "loss"))
    turns = chat.parsed(F.col("formatted"))
    flat = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.masked(F.col("formatted"), F.col("loss"))
    return out.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
                      F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op9_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_levels.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_projection_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_ann.neighbours(table(spark, sf_dir, "embeddings"))


def op11_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


def op12_middle_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = middle_fill.transformed(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(middle_fill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(query: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return query(spark, sf_dir)

        return run

    return {name: shipped(f) for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op7_containment": containment.CONTAINED_SQL, "op8_chat": chat.FORMAT_SQL}
