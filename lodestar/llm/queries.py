"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import chat, decontaminate, langid, mix, packages, quality, ranked, repeats, secrets, simhash, tokencount, urlgraph, whitening
from lodestar.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_digest(table(spark, sf_dir, "documents"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts look like the template's own marks."""
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], told.schema)
    return told.unionByName(own)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(_conversations(spark, sf_dir))


def chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expansion itself: every assistant turn with its whole context."""
    return chat.examples(chat.format_conversations(_conversations(spark, sf_dir))).drop("example")


def language_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.calibration(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_digest(table(spark, sf_dir, "documents"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats_digest(table(spark, sf_dir, "documents"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.url_digest(table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_digest(table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.archive_digest(table(spark, sf_dir, "pages"))


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_mix": op2_mix,
    "op3_urls": op3_urls,
    "op4_tokens": op4_tokens,
    "op5_quality": op5_quality,
    "op6_repeats": op6_repeats,
    "op7_language": op7_language,
    "op8_simhash": op8_simhash,
    "op9_chat": op9_chat,
    "op10_secrets": op10_secrets,
    "op11_whitening": op11_whitening,
    "op12_ranked": op12_ranked,
    "op13_warc": op13_warc,
    "chat_examples": chat_examples,
    "language_calibration": language_calibration,
}
