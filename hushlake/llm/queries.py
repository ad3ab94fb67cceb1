"""The registered queries of the training-data operators, each over its whole table, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.llm import bpe, chat, chunks, decontam, flac, html, langid, license, minhash, suffix
from hushlake.llm.common import scratch, stored, table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_spans(table(spark, sf_dir, "documents"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85, size=3)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        return stored(suffix.remove_repeats(table(spark, sf_dir, "documents"), "sha256"), result=True)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.summary(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = docs.select("doc_id", "text", langid.held_out().alias("held_out"))
    return langid.predict(marked, langid.train(docs), ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), RANKS, PATTERN, digests_only=True)


def op9_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_column(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.conversation_digests(rows.unionByName(spark.sql(f"SELECT * FROM {chat.PLANTED}")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_minhash_dedup, op3_suffix_dedup, op4_html_extraction, op5_license_scan, op6_decontamination, op7_language_id, op8_bpe_round_trip, op9_flac_media, op10_chat_format)
}

ORACLES: dict[str, str] = {"op2_minhash_dedup": minhash.ORACLE, "op10_chat_format": chat.ORACLE}
