"""A training corpus from raw documents: quality rules, exact dedup, near dedup, source mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next stage's ``docs``. All but the last return the columns of ``documents``. As a stage's result is written when the next one
begins, each stage first deletes the intermediate tables of the stages before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from datawright.llm import exact_dedup, jaccard_join, mixing, quality_rules, sentencepiece_codec
from datawright.llm.common import drop, scope, ship, staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(work: Callable[[DataFrame], DataFrame]) -> Stage:
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scope(ship(spark), f"pipeline {sf_dir}", docs):
            return work(docs)

    return stage


#: Documents that the quality rules reject go.
quality = _stage(quality_rules.filtered)
#: Of identical texts the one with the largest id stays.
exact = _stage(exact_dedup.deduplicate)
#: Of texts connected by a 5-word Jaccard similarity of 0.75 or more the one with the smallest id stays.
near = _stage(jaccard_join.representatives)
#: A document appears as often as the mix takes it.
mixed = _stage(mixing.mixed_documents)
#: Token ids of every document of the mix, once for each time that it appears.
tokens = _stage(lambda docs: sentencepiece_codec.encode(docs, keep=("doc_id", "lang", "source")))

STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("source_mixing", mixed), ("sentencepiece", tokens)]

#: Near dedup and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``; between stages only the result of the last one is kept."""
    docs, before = table(ship(spark), sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
