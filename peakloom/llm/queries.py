"""The registered queries of the operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversation_trie, decontam, fill_in_middle, license_scan, line_dedup, media, minhash, oracles, quality, secret_scan, suffix_dedup, token_counts, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(_documents(spark, sf_dir))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_documents(spark, sf_dir))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.token_digests(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(_documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(_documents(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digests(_documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The entries of the url query: (host, path, verdict).
URL_ENTRIES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_ENTRIES)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.middle_digests(_documents(spark, sf_dir))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie_nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_token_counts, op2_secret_scan, op3_minhash, op4_media_columns, op5_quality_classifier, op6_bpe, op7_suffix_dedup, op8_line_dedup, op9_license_scan, op10_decontamination, op11_url_filter, op12_fill_in_middle, op13_conversation_trie)}


def oracle_sql() -> dict[str, str]:
    """Tokenizers, images and the classifier aren't SQL; their tests hold them against brute force."""
    return {
        "op2_secret_scan": oracles.secrets(),
        "op3_minhash": oracles.near_duplicates(),
        "op7_suffix_dedup": oracles.repeats(),
        "op8_line_dedup": oracles.lines(),
        "op9_license_scan": oracles.licenses(),
        "op10_decontamination": oracles.contamination(),
        "op11_url_filter": oracles.url_verdicts(URL_ENTRIES),
        "op12_fill_in_middle": oracles.fill_in_middle(),
        "op13_conversation_trie": oracles.conversation_trie(),
    }
