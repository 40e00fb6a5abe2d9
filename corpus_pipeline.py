"""Corpus pipeline: quality rules, near-duplicates, decontamination, secret masking, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written before the next stage reads it:

* quality: documents that fail their own rules, or whose domain is rejected, go.
* near_duplicates: one document of each component of near copies stays (five-word shingles, Jaccard similarity 0.8 or more).
* decontamination: documents that hold a passage of the benchmark go.
* secrets: secrets in texts are masked; all documents stay.
* mix: documents are repeated, kept once or left out, so that sources have their target words.

All but the last return the columns of ``documents``, and so does the last, with a row for each copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import decontaminate, mix, quality, secrets, simhash
from lodestar.llm.common import checkpoint, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mix", mix_stage),
]

#: SQL can't express components of near copies; the tests hold the stages against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what goes from one to the next is checkpointed, as stages read it more than once."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else checkpoint(docs), sf_dir)
    return docs
