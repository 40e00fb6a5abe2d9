"""Reranking of retrieved pools by query-term coverage and by pseudo-relevance feedback.

A pool has a row per (query_id, id) with query, score, rank, title and abstract; all steps are windows per query over the pool,
so nothing but the pool is dealt out. Weights are fixed values of the techniques.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.functions.numbers import number, round_half_up

# Fixed values of the techniques.
COVERAGE_WEIGHT = 0.08
POOL_SIZE = 50
EXPANDED_SIZE = 80
EXPANSION_BOOSTS = {"title": 1.4, "abstract": 1.1, "text": 0.4}


@dataclass(frozen=True)
class Feedback:
    documents: int = 4
    terms: int = 8
    original: float = 0.06
    expansion: float = 0.14
    phrase: float = 0.01


def coverage(asked: Column, title: Column, text: Column) -> Column:
    """(3 in the title + 2 in the body + 1 in either) / distinct terms asked: 0 to 6."""
    wanted = F.array_distinct(asked)
    hits = lambda words: F.size(F.array_intersect(wanted, words))
    total = 3 * hits(title) + 2 * hits(text) + hits(F.concat(title, text))
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(total / F.greatest(F.size(wanted), F.lit(1)))


def phrase_coverage(asked: Column, title: Column, text: Column) -> Column:
    """(3 in the title + 2 in the body) / distinct pairs of neighbours asked: 0 to 5."""
    wanted = F.array_distinct(tx.bigrams(asked))
    hits = lambda words: F.size(F.array_intersect(wanted, tx.bigrams(words)))
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise((3 * hits(title) + 2 * hits(text)) / F.greatest(F.size(wanted), F.lit(1)))


def _tokens(pool: DataFrame, stopwords: list[str], body: str) -> DataFrame:
    return pool.withColumns({"asked": tx.significant_tokens(F.col("query"), stopwords), "in_title": tx.significant_tokens(F.col("title"), stopwords), "in_body": tx.significant_tokens(F.col(body), stopwords)})


def share_of_best(score: Column, *keys: str) -> Column:
    """The score by the pool's largest, which counts as 1 at least."""
    return number(score) / F.greatest(F.max(number(score)).over(Window.partitionBy("query_id", *keys)), F.lit(1.0))


def _ranked(scored: DataFrame, *keys: str) -> DataFrame:
    order = Window.partitionBy("query_id", *keys).orderBy(F.col("rerank_score").desc(), F.col("original_rank"))
    return scored.withColumn("rank", F.row_number().over(order))


def by_coverage(pool: DataFrame, *, body: str = "abstract") -> DataFrame:
    """(query_id, id, score, original_rank, rerank_score, rank)."""
    own = _tokens(pool, tx.COVERAGE_STOPWORDS, body)
    score = round_half_up(share_of_best(F.col("score")) + COVERAGE_WEIGHT * coverage(F.col("asked"), F.col("in_title"), F.col("in_body")))
    return _ranked(own.withColumn("rerank_score", score).withColumn("original_rank", F.col("rank"))).select("query_id", "id", "score", "original_rank", "rerank_score", "rank")


def feedback_terms(pool: DataFrame, *, feedback: Feedback = Feedback(), body: str = "abstract", stopwords: list[str] | None = None) -> DataFrame:
    """(query_id, term, weight, place): terms of the best documents, each occurrence weighing 1 / rank, titles twice, without the query's own."""
    stop = tx.FEEDBACK_STOPWORDS if stopwords is None else stopwords
    best = pool.where(F.col("rank") <= feedback.documents)
    words = F.filter(tx.significant_tokens(tx.feedback_text("title", body), stop), lambda t: ~F.array_contains(tx.significant_tokens(F.col("query"), stop), t))
    each = best.select("query_id", "rank", F.explode(words).alias("term"))
    weighed = each.groupBy("query_id", "term").agg(round_half_up(F.sum(F.lit(1.0) / F.col("rank")), 9).alias("weight"))
    order = Window.partitionBy("query_id").orderBy(F.col("weight").desc(), F.col("term"))
    return weighed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= feedback.terms)


def _expanded(pool: DataFrame, terms: DataFrame) -> DataFrame:
    lists = terms.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "term"))), lambda t: t["term"]).alias("expansion"))
    return pool.join(lists, "query_id", "left").withColumn("expansion", F.coalesce("expansion", F.array().cast("array<string>")))


def by_feedback(pool: DataFrame, *, feedback: Feedback = Feedback(), body: str = "abstract", terms: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, original_rank, rerank_score, rank)."""
    terms = feedback_terms(pool, feedback=feedback, body=body) if terms is None else terms
    own = _tokens(_expanded(pool, terms), tx.FEEDBACK_STOPWORDS, body)
    score = round_half_up(
        share_of_best(F.col("score"))
        + feedback.original * coverage(F.col("asked"), F.col("in_title"), F.col("in_body"))
        + feedback.expansion * coverage(F.col("expansion"), F.col("in_title"), F.col("in_body"))
        + feedback.phrase * phrase_coverage(F.col("asked"), F.col("in_title"), F.col("in_body"))
    )
    return _ranked(own.withColumn("rerank_score", score).withColumn("original_rank", F.col("rank"))).select("query_id", "id", "score", "original_rank", "rerank_score", "rank")


def feedback_grid(pool: DataFrame, phrase_weights: list[float], *, feedback: Feedback = Feedback(), body: str = "abstract") -> DataFrame:
    """``by_feedback`` for several phrase weights at once: rows as its, with phrase_weight."""
    own = _tokens(_expanded(pool, feedback_terms(pool, feedback=feedback, body=body)), tx.FEEDBACK_STOPWORDS, body)
    fixed = share_of_best(F.col("score")) + feedback.original * coverage(F.col("asked"), F.col("in_title"), F.col("in_body")) + feedback.expansion * coverage(F.col("expansion"), F.col("in_title"), F.col("in_body"))
    own = own.select("query_id", "id", "score", F.col("rank").alias("original_rank"), fixed.alias("fixed"), phrase_coverage(F.col("asked"), F.col("in_title"), F.col("in_body")).alias("phrase"))
    each = own.withColumn("phrase_weight", F.explode(F.array(*[F.lit(float(w)) for w in phrase_weights])))
    scored = each.withColumn("rerank_score", round_half_up(F.col("fixed") + F.col("phrase_weight") * F.col("phrase")))
    return _ranked(scored, "phrase_weight").select("phrase_weight", "query_id", "id", "original_rank", "rerank_score", "rank")


def merged_pools(original: DataFrame, expanded: DataFrame) -> DataFrame:
    """All documents of two pools (query_id, id, score, rank): scores (0 where absent), ranks (null) and sources of each."""
    first = original.select("query_id", "id", number(F.col("score")).alias("original_score"), F.col("rank").alias("original_rank"))
    second = expanded.groupBy("query_id", "id").agg(F.max(number(F.col("score"))).alias("expanded_score"), F.min("rank").alias("expanded_rank"))
    both = first.join(second, ["query_id", "id"], "full_outer")
    sources = F.filter(F.array(F.when(F.col("original_rank").isNotNull(), F.lit("original")), F.when(F.col("expanded_rank").isNotNull(), F.lit("expanded"))), lambda s: s.isNotNull())
    return both.select("query_id", "id", number(F.col("original_score")).alias("original_score"), number(F.col("expanded_score")).alias("expanded_score"), "original_rank", "expanded_rank", sources.alias("retrieval_sources"))


def by_expanded_feedback(merged: DataFrame, details: DataFrame, terms: DataFrame, *, body: str = "abstract") -> DataFrame:
    """Merged pools ranked by both scores and coverage; ``details`` has query_id, id, query, title and the body."""
    own = _tokens(_expanded(merged.join(details, ["query_id", "id"]), terms), tx.FEEDBACK_STOPWORDS, body)
    score = round_half_up(
        0.62 * share_of_best(F.col("original_score"))
        + 0.38 * share_of_best(F.col("expanded_score"))
        + 0.06 * coverage(F.col("asked"), F.col("in_title"), F.col("in_body"))
        + 0.14 * coverage(F.col("expansion"), F.col("in_title"), F.col("in_body"))
    )
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), F.col("original_rank").asc_nulls_last(), F.col("expanded_rank").asc_nulls_last())
    return own.withColumn("rerank_score", score).withColumn("rank", F.row_number().over(order)).select("query_id", "id", "original_score", "expanded_score", "original_rank", "expanded_rank", "retrieval_sources", "rerank_score", "rank")
