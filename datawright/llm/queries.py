"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, html_extract, jaccard_join, license_scan, mixing, quality_rules, sentencepiece_codec, token_counts, url_filter, warc_fixity
from .common import ship, table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), verify=True)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_fixity.trial(table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(ship(spark), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_sentencepiece, op2_url_filter, op3_token_counts, op4_license_scan, op5_jaccard_join, op6_html_extract,
        op7_warc_fixity, op8_exact_dedup, op9_source_mixing, op10_quality_rules,
    )
    return {f.__name__: _shipped(f) for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_jaccard_join": jaccard_join.SQL,
        "op7_warc_fixity": warc_fixity.SQL,
        "op8_exact_dedup": exact_dedup.SQL,
        "op9_source_mixing": "SELECT doc_id, size, source_size, target, taken FROM (" + mixing.SQL + ")",
        "op10_quality_rules": quality_rules.SQL,
    }
