"""The registered queries of the training-data operators: thin applications to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.llm import (conversations, decontaminate, language, line_dedup, near_dedup, packing, quality, secrets, sharding,
                          substring_dedup, token_alignment, token_counts, warc)
from tracekit.llm.common import read

LINE_WORDS = 8               # op8 looks at repeated runs of lines with so many words; the pipeline's stage keeps line_dedup.MIN_WORDS


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.scan(spark, read(spark, sf_dir, "documents")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = decontaminate.report(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit_words").cast("long")
    return r.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), token_counts.default_vocabulary())


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    manifest = warc.write_archives(spark, warc.plan_records(pages))
    return warc.read_archives(spark, manifest, pages.schema["page_id"].dataType.simpleString())


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = language.held_out(F.col("doc_id"))
    model = language.fit(spark, docs.where(~held))
    return language.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest_columns(substring_dedup.remove_repeats(spark, read(spark, sf_dir, "documents")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), token_counts.default_vocabulary())


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(spark, read(spark, sf_dir, "documents"), LINE_WORDS)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark, read(spark, sf_dir, "documents")).drop("_h")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(spark, read(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return conversations.repair_report(spark, conversations.damage(turns), turns)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_report(spark, read(spark, sf_dir, "documents"), *token_alignment.default_vocabularies())


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(spark, read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_secret_scan, op2_decontaminate, op3_packing, op4_warc, op5_language, op6_substring_dedup, op7_token_counts,
    op8_line_dedup, op9_near_dedup, op10_quality, op11_conversation_repair, op12_token_alignment, op13_sharding)}

ORACLE_SQL: dict[str, str] = {}
