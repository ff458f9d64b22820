"""The queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, fingerprints, huffman, interpolation, jaccard, licenses, packing, passages, token_counts, toxicity
from .shared import crc_of_id, table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"), licenses.templates(spark))


def op1_license_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.license_passages(table(spark, sf_dir, "documents"), licenses.templates(spark, passages.texts()))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=20)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s.end - s.begin)
    told = lambda items, n, digest: (F.size(items).cast("bigint").alias(n), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias(digest))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), *told("items", "n_items", "items_sha256"), (F.size("spans") > 0).alias("contaminated"), *told("near_items", "n_near", "near_sha256"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_neighbours(table(spark, sf_dir, "documents"), k=5, l=2, m=64)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


def op5_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = huffman.write_ids(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end_id=0)
    return huffman.read_ids(spark, folder)


def op6_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.scores(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    back = chat.read_chats(chat.format_chats(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", F.coalesce(crc_of_id() % 5 == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from .sql import SQL

    return dict(SQL)
