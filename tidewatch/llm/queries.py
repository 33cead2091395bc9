"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import ann, chat, decontam, htmltext, langid, merkle, mix, neardup, periodic, quality, secrets, shard, tokencount
from tidewatch.llm.common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_plan(table(spark, sf_dir, "documents"))


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_plan(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", chat.TRAP_TEXT), (-7, 1, "assistant", chat.TRAP_TEXT)],
                                 "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(trap)))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(table(spark, sf_dir, "documents"), width=2).drop("text_md5")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.page_texts(table(spark, sf_dir, "pages"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_digests(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_chat_format": op2_chat_format,
    "op3_shard": op3_shard,
    "op4_language_id": op4_language_id,
    "op5_quality": op5_quality,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_token_counts": op7_token_counts,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_decontaminate": op9_decontaminate,
    "op10_secret_scan": op10_secret_scan,
    "op11_html_text": op11_html_text,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": mix.MIX_SQL,
    "op2_chat_format": chat.CHAT_SQL,
    "op6_nearest_neighbours": ann.ANN_SQL,
    "op8_near_duplicates": neardup.NEARDUP_SQL,
    "op9_decontaminate": decontam.DECONTAM_SQL,
    "op11_html_text": htmltext.HTML_SQL,
    "op12_merkle_manifest": merkle.MERKLE_SQL,
    "op13_periodic_runs": periodic.PERIODIC_SQL,
}
